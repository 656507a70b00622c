"""BM25 and dense retrieval, and the steps from ranked passages to evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.analysis import analysed
from ..operators import block_max, fulltext, vector_index
from ..operators import retrieval as R
from ..sources.shared import fresh_path
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_JOINED = "regexp_replace(regexp_replace({0}, '([0-9]),([0-9]{{2,3}})\\b', '\\1\\2', 'g'), '([0-9]),([0-9]{{2,3}})\\b', '\\1\\2', 'g')"
_TERMS = f"regexp_extract_all(lower({_JOINED} || ' ' || array_to_string(list_transform(regexp_extract_all({_JOINED}, '\\pL+(?:-\\pL+)+'), lambda w: replace(w, '-', '')), ' ')), '[\\pL\\pM]+|\\p{{{{Nd}}}}+(?:\\.\\p{{{{Nd}}}}+)?')"
_BLOCKS = "SELECT doc_id, i - 1 AS ordinal, ls[i] AS text, lang FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)"
_POST = f"""b AS ({_BLOCKS}), w AS (SELECT doc_id, ordinal, lang, {_TERMS.format('text')} AS ts FROM b),
e AS (SELECT doc_id, ordinal, lang, len(ts) AS len, unnest(ts) AS term FROM w),
p AS (SELECT doc_id, ordinal, lang, len, term, count(*) AS tf, count(*) * 22e-1 / (count(*) + 12e-1 * (25e-2 + 75e-2 * len / 9921e-2)) AS weight FROM e GROUP BY doc_id, ordinal, lang, len, term),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM b)::DOUBLE - count(*) + 5e-1) / (count(*) + 5e-1) + 1e0) AS idf FROM p GROUP BY 1),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TERMS.format('text')})) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, ordinal, lang, round(sum(weight * idf), 9) AS score FROM p JOIN idf USING (term) JOIN q USING (term) GROUP BY query_id, doc_id, ordinal, lang)"""


@query(f"SELECT item_id, CAST(unnest(range(1, len(ts) + 1)) AS INT) AS place, unnest(ts) AS term FROM (SELECT item_id, {_TERMS.format('text')} AS ts FROM benchmark UNION ALL SELECT -1 - doc_id, {_TERMS.format('text')} FROM documents)")
def i5_analysed_terms(t):
    """The terms of every document (below 0) and query, in order, by the one chain both go through."""
    texts = t.benchmark.select("item_id", "text").unionAll(t.documents.select(-1 - F.col("doc_id"), "text"))
    return texts.select("item_id", F.posexplode(analysed(F.col("text"))).alias("place", "term")).withColumn("place", F.col("place") + 1)


def _index(t):
    chunks = R.blocks(t.documents)
    post = R.postings(chunks, ["doc_id", "ordinal", "lang"])
    return chunks, post, R.inverse_frequencies(post, chunks.count())


def _queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_POST} SELECT doc_id, ordinal, term, tf, round(weight, 9) AS weight FROM p")
def g2_bm25_weights(t):
    return R.postings(R.blocks(t.documents), ["doc_id", "ordinal"]).select("doc_id", "ordinal", "term", "tf", F.round("weight", 9).alias("weight"))


@query(f"WITH {_POST} SELECT term, df, round(idf, 9) AS idf FROM idf")
def g4_idf(t):
    return _index(t)[2].select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {_POST} SELECT query_id, doc_id, ordinal, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s) WHERE rank <= 5")
def g3_bm25_search(t):
    """The five best blocks for each benchmark text."""
    return R.bm25_best(R.blocks(t.documents), _queries(t), ["doc_id", "ordinal"], 5).select("query_id", "doc_id", "ordinal", F.round("score", 5).alias("score"), "rank")


def _block_index(t) -> block_max.Blocks:
    path = fresh_path(t.spark, "blocks")
    block_max.write_blocks(R.blocks(t.documents), path, ["doc_id", "ordinal"], ["lang"])
    return block_max.Blocks(t.spark, path)


@query(f"WITH {_POST} SELECT query_id, doc_id, ordinal, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s) WHERE rank <= 5")
def g3_block_max_search(t):
    """As g3_bm25_search, from a kept index of which only blocks that can reach the bar are read."""
    return _block_index(t).search(_queries(t), ["doc_id", "ordinal"], 5).select("query_id", "doc_id", "ordinal", F.round("score", 5).alias("score"), "rank")


@query()
def f5_blocks_read(t):
    """How many blocks of its terms' postings each of these searches reads, and how many there are."""
    return _block_index(t).blocks_read(_queries(t), ["doc_id", "ordinal"], 5)


@query(f"WITH {_POST} SELECT query_id, doc_id, ordinal, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s WHERE lang IN ('en', 'de') AND doc_id BETWEEN 100 AND 600) WHERE rank <= 5")
def b1_filtered_search(t):
    """Hard filters come before the ranking, never after its limit."""
    chunks = R.blocks(t.documents)
    scope = R.hard_filter(chunks, lang=["en", "de"], doc_id=(100, 600))
    return R.bm25_best(chunks, _queries(t), ["doc_id", "ordinal"], 5, scope).select("query_id", "doc_id", "ordinal", "rank")


@query(f"WITH {_POST} SELECT query_id, doc_id, ordinal, rank FROM (SELECT query_id, doc_id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s SEMI JOIN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 1000) d USING (doc_id)) WHERE rank <= 5")
def b1_filtered_search_whole(t):
    """As b1_filtered_search, over all documents: its range is one of lengths without an upper bound, not of ids."""
    scope = R.blocks(R.hard_filter(t.documents, lang=["en", "de"], n_chars=(1000, None)))
    return R.bm25_best(R.blocks(t.documents), _queries(t), ["doc_id", "ordinal"], 5, scope).select("query_id", "doc_id", "ordinal", "rank")


def _boolean(words: list[str]) -> str | None:
    """A query with a phrase, a word, an unwanted word and an alternative, from a text's first seven terms."""
    return f'"{words[0]} {words[1]}" {words[2]} -{words[3]} OR "{words[4]} {words[5]} {words[6]}"' if len(words) > 6 else None


def _boolean_queries(t) -> list[tuple[int, str]]:
    """The stated queries: one for each benchmark text."""
    asked = t.benchmark.select("item_id", F.slice(analysed(F.col("text")), 1, 7).alias("ws")).orderBy("item_id").collect()
    return [(r["item_id"], _boolean(r["ws"])) for r in asked if _boolean(r["ws"])]


_HAS = "contains(' ' || array_to_string(w.ts, ' ') || ' ', ' ' || {0} || ' ')"


@query(f"""WITH b AS ({_BLOCKS}), w AS (SELECT doc_id, ordinal, {_TERMS.format('text')} AS ts FROM b), q AS (SELECT item_id AS query_id, {_TERMS.format('text')} AS q FROM benchmark)
SELECT query_id, doc_id, ordinal FROM w, q WHERE len(q) > 6 AND (({_HAS.format("q[1] || ' ' || q[2]")} AND {_HAS.format('q[3]')} AND NOT {_HAS.format('q[4]')}) OR {_HAS.format("q[5] || ' ' || q[6] || ' ' || q[7]")})""")
def g9_boolean_search(t):
    """The blocks that a boolean query made of each benchmark text finds, by intersection of position lists."""
    return fulltext.full_text(R.blocks(t.documents), _boolean_queries(t), ["doc_id", "ordinal"]).select("query_id", "doc_id", "ordinal")


@query()
def g9_cover_density(t):
    """The ten best blocks for each such query by cover density; held against plain Python in tests."""
    return fulltext.full_text(R.blocks(t.documents), _boolean_queries(t), ["doc_id", "ordinal"], 10)


@query(f"""WITH b AS ({_BLOCKS}), w AS (SELECT doc_id, ordinal, {_TERMS.format('text')} AS ts FROM b), q AS (SELECT item_id AS query_id, {_TERMS.format('text')} AS q FROM benchmark WHERE item_id < 8)
SELECT query_id, doc_id, ordinal FROM w, q WHERE len(q) > 6 AND (({_HAS.format("q[1] || ' ' || q[2]")} AND {_HAS.format('q[3]')} AND NOT {_HAS.format('q[4]')}) OR {_HAS.format("q[5] || ' ' || q[6] || ' ' || q[7]")})""")
def g9_positional_index(t):
    """The first eight of these queries from an index that is kept with its positions."""
    path = fresh_path(t.spark, "positions")
    fulltext.write_positions(R.blocks(t.documents), path, ["doc_id", "ordinal"])
    asked = [q for q in _boolean_queries(t) if q[0] < 8]
    return fulltext.search_positions(fulltext.read_positions(t.spark, path), asked, ["doc_id", "ordinal"]).select("query_id", "doc_id", "ordinal")


_DENSE = "n AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_dot_product(a.v, b.v), 9) AS score FROM n a, n b WHERE a.vec_id % 100 = 0)"


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 10")
def g1_dense_search(t):
    """The ten nearest vectors to each whose id is divisible by 100, exactly."""
    queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(t.embeddings, queries, "vec_id", 10).withColumn("score", F.round("score", 5))


def _vector_index(t) -> vector_index.Vectors:
    path = fresh_path(t.spark, "vectors")
    vector_index.write_vectors(t.embeddings, path, "vec_id", ["label"])
    return vector_index.Vectors(t.spark, path)


def _hundredths(t):
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def a26_vector_index_search(t):
    """The ten nearest vectors from a kept index of lists; a query reads the lists of its nearest centroids."""
    return _vector_index(t).search(_hundredths(t), "vec_id", 10)


@query()
def a26_vector_index_recall(t):
    """How many of each query's ten nearest that search finds, against the exact one."""
    return vector_index.recall(a26_vector_index_search(t), R.dense(t.embeddings, _hundredths(t), "vec_id", 10), "vec_id")


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d WHERE label % 3 = 1) WHERE rank <= 10")
def a26_filtered_index_search(t):
    """All lists of the index, a payload filter pushed to their scan: exact."""
    hits = _vector_index(t).search(_hundredths(t), "vec_id", 10, vector_index.MOST_LISTS, F.col("label") % 3 == 1)
    return hits.withColumn("score", F.round("score", 5))


@query(f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, vec_id) AS rank FROM d), k AS (SELECT *, CASE WHEN rank <= CASE WHEN label % 2 = 0 THEN 6 ELSE 4 END THEN 0 ELSE 1 END AS a FROM r) SELECT query_id, vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a, label % 2, rank) AS place FROM k) WHERE place <= 10")
def g5_allocation(t):
    queries = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    vectors = t.embeddings.withColumn("kind", F.when(F.col("label") % 2 == 0, "narrative").otherwise("table"))
    return R.allocate(R.dense(vectors, queries, "vec_id", 10, "kind"), 10, "kind", "narrative").select("query_id", "vec_id", "place")


_LISTS = f"""{_POST}, lex AS (SELECT query_id, doc_id, max(score) AS score FROM s GROUP BY 1, 2),
l1 AS (SELECT query_id, doc_id, 'bm25' AS retriever, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex),
l2 AS (SELECT query_id, doc_id, 'sum' AS retriever, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 6) DESC, doc_id) AS rank FROM s GROUP BY 1, 2),
l AS (SELECT * FROM l1 WHERE rank <= 20 UNION ALL SELECT * FROM l2 WHERE rank <= 20)"""


def _lists(t):
    """Two lists of documents from one scoring of their blocks: by the best block, and by the sum of all."""
    per = R.bm25_documents(t.documents, _queries(t), "doc_id", 20)
    both = R.ranked(R.ranked(per, ["query_id"], [F.desc("best"), "doc_id"], None, "by_m"), ["query_id"], [F.desc("total"), "doc_id"], None, "by_s")
    entry = lambda name, score, rank: F.struct(F.lit(name).alias("retriever"), F.col(score).alias("score"), F.col(rank).alias("rank"))
    lists = both.filter("by_m <= 20 OR by_s <= 20").select("query_id", "doc_id", F.explode(F.array(entry("bm25", "best", "by_m"), entry("sum", "total", "by_s"))).alias("x"))
    return lists.select("query_id", "doc_id", "x.*").filter("rank <= 20")


@query(f"WITH {_LISTS} SELECT query_id, doc_id, round(score, 9) AS score, place FROM (SELECT query_id, doc_id, sum(1e0 / (rank + 60)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1e0 / (rank + 60)), 12) DESC, min(rank), doc_id) AS place FROM l GROUP BY 1, 2) WHERE place <= 10")
def g6_rank_fusion(t):
    return R.fuse(_lists(t), "doc_id", 60, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "place")


@query(f"WITH {_LISTS}, f AS (SELECT query_id, doc_id, count(*) AS n, max(retriever) AS r FROM l GROUP BY 1, 2) SELECT query_id, count(*) FILTER (n > 1) AS both, count(*) FILTER (n = 1 AND r = 'bm25') AS one, count(*) FILTER (n = 1 AND r = 'sum') AS other FROM f GROUP BY 1")
def d27_retriever_overlap(t):
    f = R.fuse(_lists(t), "doc_id")
    c = F.col("contributions")
    return f.groupBy("query_id").agg(F.count_if(F.size(c) > 1).alias("both"), F.count_if((F.size(c) == 1) & F.map_contains_key(c, "bm25")).alias("one"), F.count_if((F.size(c) == 1) & F.map_contains_key(c, "sum")).alias("other"))


@query("SELECT item_id, round(CAST(('0x' || left(sha256('query' || chr(0) || text), 16))::UBIGINT AS DOUBLE) / 18446744073709551616e0, 9) AS score FROM benchmark", name="g11_stand_in_rerank")
def g11_stand_in_rerank(t):
    value = F.conv(F.substring(F.sha2(F.concat(F.lit("query\0"), "text"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return t.benchmark.select("item_id", F.round(value / F.lit(18446744073709551616.0), 9).alias("score"))


@query(f"WITH {_POST}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s), k AS (SELECT h.query_id, h.rank, h.doc_id, h.ordinal, row_number() OVER (PARTITION BY h.query_id, b.text ORDER BY h.rank) AS r FROM h JOIN b USING (doc_id, ordinal) WHERE h.rank <= 5) SELECT query_id, rank, doc_id, ordinal FROM k WHERE r = 1")
def g12_evidence_dedupe(t):
    """Ranked passages of a query; one whose source block is, as a whole, that of one kept before is absorbed."""
    hits = QUERIES["g3_bm25_search"](t.spark, t.folder).join(R.blocks(t.documents).select("doc_id", "ordinal", F.array(F.sha2("text", 256)).alias("elements")), ["doc_id", "ordinal"])
    items = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "ordinal", "elements"))).alias("items"))
    return items.select("query_id", F.explode(R.greedy_dedupe(F.col("items"))).alias("x")).select("query_id", "x.rank", "x.doc_id", "x.ordinal")


_BUDGET = """WITH RECURSIVE i AS (SELECT source, list({'d': doc_id, 'c': length(text)} ORDER BY doc_id) AS xs FROM documents GROUP BY 1),
f AS (SELECT source, xs, 1 AS i, xs[1].c AS used, true AS kept FROM i UNION ALL
  SELECT source, xs, f.i + 1, CASE WHEN used + xs[f.i + 1].c <= 22000 THEN used + xs[f.i + 1].c ELSE used END, used + xs[f.i + 1].c <= 22000 FROM f WHERE f.i < len(xs))
SELECT source, xs[i].d AS doc_id FROM f WHERE kept"""


@query(_BUDGET)
def g15_character_budget(t):
    """Whole passages of each source in order, up to 22,000 characters; a smaller one after one that doesn't fit may still."""
    items = t.documents.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.length("text").cast("long").alias("chars")))).alias("items"))
    return items.select("source", F.explode(R.within_budget(F.col("items"), 22_000)).alias("x")).select("source", "x.doc_id")


@query("SELECT event_id FROM events ORDER BY CASE WHEN event_id % 2 = 1 THEN event_id ELSE 1000000000 - event_id END")
def f10_edge_order(t):
    return t.events.select("event_id").orderBy(R.edge_order(F.col("event_id")))
