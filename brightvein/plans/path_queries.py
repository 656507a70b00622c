"""Queries over the path from blocks to answers: headings, figures, chunks, hybrid search, reranking, claims, manifests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, evidence, generations, hybrid, reports, sections, spatial
from ..operators import retrieval as R
from ..sources import intake
from . import retrieval_queries as Q
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_LEVEL = r"""CASE WHEN line = '' OR length(line) > 120 THEN NULL
  WHEN regexp_matches(split_part(line, ' ', 1), '^[0-9]{1,2}[.]([0-9]{1,2})?([.][0-9]{1,2}){0,2}$') THEN
    CASE WHEN length(title) >= 3 AND regexp_matches(title, '^\p{Lu}') AND NOT regexp_matches(title, '[.!?]$') THEN CAST(len(list_filter(string_split(split_part(line, ' ', 1), '.'), lambda x: x <> '')) AS INT) END
  WHEN regexp_matches(line, '(?i)^(item|note|notes|annexure|annex|schedule|section|part|chapter|appendix) [0-9IVXLC]{1,6}([^0-9A-Za-z_]|$)') THEN 1 END"""
#: Blocks with a number before every third, so that the tables' prose has headings.
_HEADED = rf"""hb AS (SELECT doc_id, ordinal, CASE WHEN ordinal % 3 = 0 THEN (doc_id % 9 + 1) || '.' || CASE WHEN ordinal % 2 = 0 THEN CAST(ordinal % 7 + 1 AS VARCHAR) ELSE '' END || '  ' || text ELSE text END AS text FROM ({Q._BLOCKS})),
hl AS (SELECT *, CASE WHEN contains(line, ' ') THEN substr(line, strpos(line, ' ') + 1) ELSE '' END AS title FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM hb)),
h AS (SELECT doc_id, ordinal, line, {_LEVEL} AS level FROM hl)"""


def _headed(t):
    number = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), F.when(F.col("ordinal") % 2 == 0, (F.col("ordinal") % 7 + 1).cast("string")).otherwise(F.lit("")), F.lit("  "))
    own = R.blocks(t.documents)
    return own.withColumn("text", F.when(F.col("ordinal") % 3 == 0, F.concat(number, "text")).otherwise(F.col("text")))


@query(f"WITH {_HEADED} SELECT doc_id, ordinal, level FROM h")
def e2_levels_of_blocks(t):
    return _headed(t).select("doc_id", "ordinal", X.heading_level(F.col("text")).alias("level"))


@query(f"""WITH {_HEADED}, heads AS (SELECT doc_id, ordinal AS o, level, line FROM h WHERE level IS NOT NULL),
live AS (SELECT b.doc_id, b.ordinal, a.o, a.line FROM h b JOIN heads a ON a.doc_id = b.doc_id AND a.o <= b.ordinal
  WHERE NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = b.doc_id AND c.o > a.o AND c.o <= b.ordinal AND c.level <= a.level))
SELECT b.doc_id, b.ordinal, coalesce(list(live.line ORDER BY live.o) FILTER (live.line IS NOT NULL), []) AS path FROM h b LEFT JOIN live ON b.doc_id = live.doc_id AND b.ordinal = live.ordinal GROUP BY 1, 2""")
def e4_paths_of_blocks(t):
    """The titles above every block."""
    own = _headed(t).withColumn("level", X.heading_level(F.col("text"))).withColumn("title", F.trim(F.regexp_replace("text", r"\s+", " ")))
    return sections.with_heading_paths(own, ["doc_id"], "ordinal", "level", "title").select("doc_id", "ordinal", F.col("heading_path").alias("path"))


@query()
def e8_chunks(t):
    """Chunks of all documents, every seventh block a table's."""
    blocks = _headed(t).select("doc_id", "ordinal", F.concat_ws(":", "doc_id", "ordinal").alias("element_id"), "text", F.floor(F.col("ordinal") / 20).cast("int").alias("page_number"), F.when(F.col("ordinal") % 7 == 6, F.lit("r")).alias("region_id"))
    return chunking.chunk(blocks)


_FIGURES = r"""list_transform(regexp_extract_all({0}, '[(]?[-−–]?[0-9][0-9,]*(?:[.][0-9]+)?[)]?'), lambda f: CASE WHEN ((f[1] = '(' AND f[-1] = ')') OR regexp_matches(f, '^[(]?[-−–]')) AND regexp_matches(f, '[1-9]') THEN '-' ELSE '' END
 || regexp_replace(split_part(regexp_replace(f, '[^0-9.]', '', 'g'), '.', 1), '^0+([0-9])', '\1') || CASE WHEN regexp_replace(split_part(regexp_replace(f, '[^0-9.]', '', 'g'), '.', 2), '0+$', '') <> '' THEN '.' || regexp_replace(split_part(regexp_replace(f, '[^0-9.]', '', 'g'), '.', 2), '0+$', '') ELSE '' END)"""


@query(f"SELECT doc_id, {_FIGURES.format('text')} AS figures FROM documents")
def h1_figures(t):
    return t.documents.select("doc_id", X.figures(F.col("text")).alias("figures"))


@query(f"WITH f AS (SELECT conv_id, turn, role, unnest({_FIGURES.format('text')}) AS figure FROM conversations), first AS (SELECT conv_id, figure, min(turn) AS began FROM f GROUP BY 1, 2) SELECT DISTINCT conv_id, turn, figure FROM f JOIN first USING (conv_id, figure) WHERE role = 'assistant' AND turn = began")
def h2_new_figures(t):
    """Figures of an assistant's turn that no turn before it in the conversation has; linear in the conversation."""
    f = t.conversations.select("conv_id", "turn", "role", F.explode(X.figures(F.col("text"))).alias("figure"))
    first = f.groupBy("conv_id", "figure").agg(F.min("turn").alias("began"))
    return f.join(first, ["conv_id", "figure"]).filter("role = 'assistant' AND turn = began").select("conv_id", "turn", "figure").distinct()


@query(r"SELECT doc_id, list_filter(['crore', 'lakh', 'thousand', 'million', 'billion', 'trillion'], lambda w: regexp_matches(lower(text), '(^|[^a-z])' || w || 's?([^a-z]|$)')) AS scales FROM documents")
def h4_scales_named(t):
    return t.documents.select("doc_id", evidence._scales(F.col("text")).alias("scales"))


@query(r"SELECT doc_id, i - 1 AS at, ls[i] AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z(₹$])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)")
def i8_sentences(t):
    return t.documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))


@query("SELECT doc_id, concat_ws(chr(10), 'Issuer: ' || nullif(trim(source), ''), 'Document: ' || replace(lang, '_', ' '), CASE WHEN doc_id % 5 = 0 THEN 'Page: 3' ELSE 'Pages: 3-' || (3 + doc_id % 5) END) || chr(10) || chr(10) || coalesce(text, '') AS enriched FROM documents")
def g13_enriched_chunks(t):
    none = F.lit(None).cast("string")
    own = t.documents.select("doc_id", "text", F.col("source").alias("issuer_name"), F.col("lang").alias("document_type"), none.alias("fiscal_period"), none.alias("reporting_basis"), none.alias("currency"), F.array().cast("array<string>").alias("heading_path"), F.array(F.lit(3).cast("long"), 3 + F.col("doc_id") % 5).alias("page_numbers"))
    return chunking.enriched(own).select("doc_id", "enriched")


# Hybrid search: BM25 over documents (their best block), and vectors standing for the documents of the same number.
_HYBRID = f"""{Q._POST},
n AS (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]])) FOR x IN embedding::DOUBLE[]] AS v FROM embeddings),
kinds AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'table_derived' ELSE 'narrative' END AS kind FROM documents),
l0 AS (SELECT query_id, s.doc_id, kind, max(score) AS score FROM s JOIN kinds ON s.doc_id = kinds.doc_id GROUP BY 1, 2, 3),
l1 AS (SELECT a.item_id AS query_id, b.vec_id AS doc_id, kind, round(list_dot_product(q.v, b.v), 9) AS score FROM benchmark a JOIN n q ON q.vec_id = a.item_id % 40 CROSS JOIN n b JOIN kinds ON kinds.doc_id = b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY retriever, query_id, kind ORDER BY score DESC, doc_id) AS rank FROM (SELECT 'bm25' AS retriever, * FROM l0 UNION ALL SELECT 'dense', * FROM l1)),
al AS (SELECT *, row_number() OVER (PARTITION BY retriever, query_id ORDER BY CASE WHEN rank <= CASE kind WHEN 'narrative' THEN 15 ELSE 10 END THEN 0 ELSE 1 END, CASE kind WHEN 'narrative' THEN 0 ELSE 1 END, rank) AS place FROM r WHERE rank <= 25),
fu AS (SELECT query_id, doc_id, sum(1e0 / (60 + rank)) AS score, min(rank) AS best, count(DISTINCT retriever) AS n, max(retriever) AS only_one FROM al WHERE place <= 25 GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, doc_id) AS place FROM fu)"""


def _hybrid(t):
    kinds = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, hybrid.TABLE).otherwise(hybrid.NARRATIVE).alias("kind"))
    chunks = R.blocks(t.documents).withColumn("kind", F.when(F.col("doc_id") % 3 == 0, hybrid.TABLE).otherwise(hybrid.NARRATIVE))
    lexical = R.bm25_best(chunks, Q._queries(t), ["doc_id", "ordinal"], hybrid.DEPTH, pool="doc_id", kind="kind").drop("rank")
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding").join(kinds, "doc_id")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("vec_id")).join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("query_id", "embedding")
    return hybrid.hybrid(hybrid.Hits(lexical), lambda: R.dense(vectors, asked, "doc_id", hybrid.DEPTH, "kind"), "doc_id", hybrid.DEPTH)


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, round(score, 9) AS score, place FROM top WHERE place <= 25")
def g7_hybrid_search(t):
    """Both retrievers per kind of evidence, ranks restarting per kind, allocated and fused."""
    return _hybrid(t).rows.select("query_id", "doc_id", F.round("score", 9).alias("score"), "place")


@query(f"WITH {_HYBRID} SELECT query_id, count(*) FILTER (n = 2) AS both, count(*) FILTER (n = 1 AND only_one = 'bm25') AS only_bm25, count(*) FILTER (n = 1 AND only_one = 'dense') AS only_dense FROM top WHERE place <= 25 GROUP BY 1")
def d27_hybrid_overlap(t):
    return hybrid.overlap(_hybrid(t).rows, "bm25", "dense")


_RERANKED = f"""{_HYBRID}, sc AS (SELECT query_id, top.doc_id, CAST(('0x' || left(sha256(b.text || chr(0) || d.text), 16))::UBIGINT AS DOUBLE) / 18446744073709551616e0 AS v FROM top JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = top.doc_id WHERE place <= 25)"""


@query(f"WITH {_RERANKED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) AS place FROM sc")
def g10_reranked(t):
    """The fused hits in the order of the stand-in scorer, called in batches."""
    from ..seams import stand_in_reranker

    return hybrid.rerank(_hybrid(t), Q._queries(t), t.documents.filter("text IS NOT NULL").select("doc_id", "text"), "doc_id", stand_in_reranker).rows.select("query_id", "doc_id", "place")


@query(f"WITH {_RERANKED}, o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, doc_id) AS place FROM sc), k AS (SELECT o.*, row_number() OVER (PARTITION BY query_id, d.text ORDER BY place) AS nth FROM o JOIN documents d USING (doc_id)) SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM k WHERE nth = 1) WHERE rank <= 5")
def f8_final_window(t):
    """Reranked by expression, copies collapsed, renumbered, and only then cut."""
    docs = t.documents.filter("text IS NOT NULL")
    fused = _hybrid(t)
    both = fused.rows.drop("place").join(Q._queries(t).withColumnRenamed("text", "q"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    ranked = hybrid.Hits(R.ranked(both.withColumn("v", hybrid.stand_in_score(F.col("q"), F.col("text"))).drop("q", "text"), ["query_id"], [F.desc("v"), "doc_id"], None, "place"))
    elements = docs.select("doc_id", F.array(F.sha2("text", 256)).alias("elements"))
    cites = docs.select("doc_id", F.lit(0).alias("position"), F.col("doc_id").cast("string").alias("element_id"), F.lit("p. 1").alias("locator"))
    return hybrid.final_window(ranked, elements, docs.select("doc_id"), cites, "doc_id", 5).rows.select("query_id", "doc_id", "rank")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS place FROM events WHERE event_type = 'click'")
def f9_newest_first_places(t):
    return t.events.filter("event_type = 'click'").select("event_id", F.row_number().over(Window.orderBy(F.desc("event_id"))).alias("place"))


@query("SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN r % 2 = 1 THEN 0 ELSE 1 END, CASE WHEN r % 2 = 1 THEN r ELSE -r END) AS shown FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)")
def f10_edge_places(t):
    """Where each line stands once odd ranks rise and then even ones fall."""
    own = R.ranked(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], None, "r")
    return R.ranked(own, ["o_orderkey"], [R.edge_order(F.col("r"))], None, "shown").select("o_orderkey", "l_linenumber", "shown")


@query("""WITH e AS (SELECT c_mktsegment AS entry_id, CASE WHEN c_nationkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, CAST(c_nationkey AS VARCHAR) AS issuer, CASE WHEN c_custkey % 500 = 0 THEN 'gone' END AS supersedes FROM customer)
SELECT 'repeated_id' AS rule, entry_id AS what FROM e GROUP BY entry_id HAVING count(*) > 1 UNION ALL SELECT 'issuer_in_several_splits', issuer FROM e GROUP BY issuer HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'supersedes_nothing', supersedes FROM e WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT entry_id FROM e)""")
def d16_corpus_rules(t):
    own = t.customer.select(F.col("c_mktsegment").alias("entry_id"), F.when(F.col("c_nationkey") % 2 == 0, "train").otherwise("test").alias("split"), F.col("c_nationkey").cast("string").alias("issuer"), F.when(F.col("c_custkey") % 500 == 0, "gone").alias("supersedes"))
    return intake.broken_corpus_rules(own)


@query("SELECT item_id, list_filter(['text', 'lang'], lambda f: f = 'lang' AND item_id % 3 = 0 OR f = 'text' AND lower(trim(text)) IN ('', 'unknown')) AS unrecorded FROM benchmark")
def b16_unrecorded(t):
    own = t.benchmark.select(F.col("item_id").alias("entry_id"), "text", F.when(F.col("item_id") % 3 == 0, " Unknown ").otherwise("en").alias("lang"))
    return intake.unrecorded_fields(own, ["text", "lang"]).withColumnRenamed("entry_id", "item_id")


_LOG = "SELECT CAST(user_id AS VARCHAR) AS generation_id, CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'shadow' ELSE 'superseded' END AS state, event_id AS seq FROM events"


@query(f"SELECT generation_id, state FROM (SELECT *, row_number() OVER (PARTITION BY generation_id ORDER BY seq DESC) AS n FROM ({_LOG})) WHERE n = 1")
def j4_current_states(t):
    """The state each generation's last event says."""
    return generations.current(_log(t)).select("generation_id", "state")


@query(f"SELECT generation_id, max(seq) AS activated FROM ({_LOG}) WHERE state = 'active' GROUP BY 1")
def j4_activations(t):
    return generations.activated_at(_log(t))


def _log(t):
    state = F.when(F.col("event_type") == "click", "active").when(F.col("event_type") == "view", "shadow").otherwise("superseded")
    return t.events.select(F.col("user_id").cast("string").alias("generation_id"), state.alias("state"), F.col("event_id").alias("seq"))


_NOTES = "SELECT event_id AS note_id, user_id % 50 AS page, chr(CAST(97 + event_id % 5 AS INT)) AS marker, (event_id % 40)::DOUBLE AS nx0, (event_id % 40 + 30)::DOUBLE AS nx1, (event_id % 701)::DOUBLE AS ny0 FROM events"
_TABLES = "SELECT *, lead(top) OVER (PARTITION BY page ORDER BY top, table_id) AS next_top FROM (SELECT s_suppkey AS table_id, s_suppkey % 50 AS page, (s_suppkey % 30)::DOUBLE AS x0, (s_suppkey % 30 + 50)::DOUBLE AS x1, (s_suppkey * 37 % 600)::DOUBLE AS top, (s_suppkey * 37 % 600 + 20)::DOUBLE AS bottom FROM supplier)"


@query(f"""WITH n AS ({_NOTES}), t AS ({_TABLES}), b AS (SELECT *, row_number() OVER (PARTITION BY page, table_id ORDER BY ny0, nx0, note_id) AS n FROM t JOIN n USING (page) WHERE ny0 >= bottom AND (next_top IS NULL OR ny0 < next_top))
SELECT table_id, marker, note_id FROM (SELECT *, row_number() OVER (PARTITION BY page, table_id, marker ORDER BY n) AS m FROM b WHERE n <= 8 AND (least(x1, nx1) - greatest(x0, nx0)) / least(x1 - x0, nx1 - nx0) > 0.3) WHERE m = 1""")
def c13_footnotes(t):
    """Footnotes bound to the table above them."""
    notes = t.events.selectExpr("event_id AS note_id", "user_id % 50 AS page", "chr(97 + event_id % 5) AS marker", "CAST(event_id % 40 AS double) AS nx0", "CAST(event_id % 40 + 30 AS double) AS nx1", "CAST(event_id % 701 AS double) AS ny0")
    own = t.supplier.selectExpr("s_suppkey AS table_id", "s_suppkey % 50 AS page", "CAST(s_suppkey % 30 AS double) AS x0", "CAST(s_suppkey % 30 + 50 AS double) AS x1", "CAST(s_suppkey * 37 % 600 AS double) AS top", "CAST(s_suppkey * 37 % 600 + 20 AS double) AS bottom")
    own = own.withColumn("next_top", F.lead("top").over(Window.partitionBy("page").orderBy("top", "table_id")))
    return spatial.footnotes(own, notes, ["page"])


@query("WITH c AS (SELECT p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey) SELECT p_partkey, s_suppkey FROM c")
def c7_current_rows(t):
    """The row that each owner's pointer names."""
    return reports.current_rows(t.part.select("p_partkey"), t.supplier.select("s_suppkey"), "p_partkey", "s_suppkey")


@query("SELECT user_id % 50 AS page, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id % 97, event_id) AS table_number, event_id FROM events WHERE event_type = 'click'")
def f3_table_numbers(t):
    own = t.events.select((F.col("user_id") % 50).alias("page"), "event_id", (F.col("event_id") % 97).alias("y"), F.when(F.col("event_type") == "click", "table").otherwise("block").alias("kind"))
    return spatial.table_numbers(own, ["page"], ["y", "event_id"]).select("page", "table_number", "event_id")
