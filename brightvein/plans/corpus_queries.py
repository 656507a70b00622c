"""Text, structure and verification over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sections
from ..operators.retrieval import blocks
from ..sources import corpus
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_BLOCKS = "SELECT doc_id, i - 1 AS ordinal, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)"


@query("SELECT page_id, CASE lower(regexp_extract(url, '(\\.[^.?#/]+)(?:[?#].*)?$', 1)) WHEN '.pdf' THEN 'application/pdf' WHEN '.html' THEN 'text/html' WHEN '.htm' THEN 'text/html' WHEN '.xml' THEN 'application/xml' WHEN '.txt' THEN 'text/plain' END AS media FROM pages")
def a5_media_type(t):
    return t.pages.select("page_id", corpus.media_type(F.col("url")).alias("media"))


@query("SELECT doc_id, sha256(text) AS digest, strlen(text) AS bytes FROM documents")
def a6_digests(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(left(html, 14)), '^\\s*<(!doctype|html)') THEN 'text/html' END AS detected FROM pages")
def a8_sniffed(t):
    return t.pages.select("page_id", corpus.sniffed(F.encode("html", "UTF-8")).alias("detected"))


@query("SELECT page_id, nullif(left(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[\\x00-\\x1F\\x7F]', '', 'g'), '^[. ]+|[. ]+$', '', 'g'), 255), '') AS name FROM pages")
def a9_filenames(t):
    return t.pages.select("page_id", X.sanitised_filename(F.col("url")).alias("name"))


@query("SELECT doc_id, 'originals/sha256/' || left(sha256(text), 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS key FROM documents")
def a11_object_keys(t):
    return t.documents.select("doc_id", X.object_key(F.sha2("text", 256)).alias("key"))


@query(f"SELECT doc_id, count(*) AS nodes, max(ordinal) AS last FROM ({_BLOCKS}) GROUP BY 1")
def a20_tree_size(t):
    return blocks(t.documents).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max("ordinal").alias("last"))


@query(f"WITH b AS ({_BLOCKS}), s AS (SELECT *, regexp_replace(text, '\\s', '', 'g') AS bare FROM b) SELECT doc_id, ordinal FROM s WHERE length(bare) > 0 AND NOT (regexp_matches(text, '[._]{{10,}}') AND (length(bare) - length(regexp_replace(bare, '[._]', '', 'g'))) / length(bare) >= 0.30)")
def b6_retrievable(t):
    return blocks(t.documents).filter(X.is_retrievable(F.col("text"))).select("doc_id", "ordinal")


@query(f"WITH b AS ({_BLOCKS}) SELECT doc_id, count(*) AS n FROM b WHERE len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) >= 12 GROUP BY 1")
def b13_prose_blocks(t):
    return blocks(t.documents).filter(X.is_prose(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, [x.n FOR x IN [{'n': 'lang', 'v': lang}, {'n': 'source', 'v': source}] IF coalesce(lower(trim(x.v)), '') IN ('', 'unknown', 'fr')] AS missing FROM documents")
def b16_unrecorded_fields(t):
    fields = F.array(*(F.struct(F.lit(c).alias("n"), F.col(c).alias("v")) for c in ("lang", "source")))
    return t.documents.select("doc_id", F.transform(F.filter(fields, lambda x: F.coalesce(F.lower(F.trim(x["v"])), F.lit("")).isin("", "unknown", "fr")), lambda x: x["n"]).alias("missing"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '[#*$%&|<>]{3,}')) AS symbols, count(*) FILTER (regexp_matches(text, '[0-9]{13,}')) AS long_numbers, count(*) FILTER (regexp_matches(text, '@[a-z0-9]+\\.')) AS addresses FROM documents")
def d24_text_census(t):
    probe = lambda p: F.count_if(F.col("text").rlike(p))
    return t.documents.agg(F.count("*").alias("n"), probe(r"[#*$%&|<>]{3,}").alias("symbols"), probe("[0-9]{13,}").alias("long_numbers"), probe(r"@[a-z0-9]+\.").alias("addresses"))


@query(f"SELECT w AS word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct({_WORDS})) AS w FROM documents) WHERE w IN ('the', 'der', 'le', 'que') GROUP BY 1")
def d25_reachability(t):
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    return t.documents.select(F.explode(words).alias("word")).filter(F.col("word").isin("the", "der", "le", "que")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1 ORDER BY n DESC, char LIMIT 20")
def d26_character_census(t):
    chars = F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7F]", ""), "")).alias("char")
    return t.documents.select(chars).filter("char <> ''").groupBy("char").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "char").limit(20)


@query("SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1")
def d12_counts_by_role(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH b AS ({_BLOCKS}), h AS (SELECT *, length(text) < 60 AS heading FROM b) SELECT doc_id, ordinal, sum(heading::int) OVER (PARTITION BY doc_id ORDER BY ordinal) AS section FROM h")
def e5_section_ids(t):
    own = blocks(t.documents).withColumn("heading", F.length("text") < 60)
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return own.select("doc_id", "ordinal", F.sum(F.col("heading").cast("int")).over(w).alias("section"))


@query(rf"""SELECT doc_id, ordinal, CASE WHEN line = '' OR length(line) > 120 THEN NULL
  WHEN regexp_matches(split_part(line, ' ', 1), '^[0-9]{{1,2}}[.]([0-9]{{1,2}})?([.][0-9]{{1,2}}){{0,2}}$') THEN CASE WHEN length(title) >= 3 AND regexp_matches(title, '^\p{{Lu}}') AND NOT regexp_matches(title, '[.!?]$') THEN CAST(len(list_filter(string_split(split_part(line, ' ', 1), '.'), lambda x: x <> '')) AS INT) END
  WHEN regexp_matches(line, '(?i)^({'|'.join(X.PARTS)}) [0-9IVXLC]{{1,6}}([^0-9A-Za-z_]|$)') THEN 1 END AS level
FROM (SELECT *, CASE WHEN contains(line, ' ') THEN substr(line, strpos(line, ' ') + 1) ELSE '' END AS title FROM (SELECT doc_id, ordinal, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM ({_BLOCKS})))""")
def e2_heading_levels(t):
    return blocks(t.documents).select("doc_id", "ordinal", X.heading_level(F.col("text")).alias("level"))


@query(f"""WITH b AS ({_BLOCKS}), h AS (SELECT doc_id, ordinal, text, length(text) % 3 + 1 AS level FROM b WHERE length(text) BETWEEN 1 AND 80),
m AS (SELECT *, min(level) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM h)
SELECT doc_id, list(text ORDER BY ordinal) AS path FROM m WHERE later IS NULL OR later > level GROUP BY 1""")
def e4_heading_paths(t):
    """Headings are short blocks; their level follows their length."""
    own = blocks(t.documents).filter("length(text) BETWEEN 1 AND 80").select("doc_id", F.struct("ordinal", (F.length("text") % 3 + 1).alias("level"), F.col("text").alias("title")).alias("h"))
    return own.groupBy("doc_id").agg(sections.heading_paths(F.array_sort(F.collect_list("h"))).alias("path"))


_WINDOWS = f"""WITH RECURSIVE b AS ({_BLOCKS}), s AS (SELECT doc_id, list(length(text) // 4 + 1 ORDER BY ordinal) AS n FROM b GROUP BY 1),
w AS (SELECT doc_id, n, 1 AS i, n[1] AS used, 0 AS pos FROM s UNION ALL
  SELECT doc_id, n, i + 1, CASE WHEN used > 0 AND used + n[i + 1] > 384 THEN n[i + 1] ELSE used + n[i + 1] END, CASE WHEN used > 0 AND used + n[i + 1] > 384 THEN pos + 1 ELSE pos END FROM w WHERE i < len(n))
SELECT doc_id, i - 1 AS ordinal, pos AS win FROM w"""


@query(_WINDOWS)
def e7_greedy_windows(t):
    """Blocks of a document in windows of at most 384 tokens, opened anew on overflow."""
    own = blocks(t.documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", X.token_estimate(F.col("text")).alias("n")))).alias("bs"))
    return own.select("doc_id", F.posexplode(sections.greedy_windows(F.transform("bs", lambda x: x["n"]), 384)).alias("ordinal", "win"))


@query("SELECT doc_id, replace(replace(replace(text, chr(8208), '-'), chr(160), ' '), chr(64257), 'fi') AS text FROM documents")
def i1_normalised(t):
    return t.documents.select("doc_id", X.normalise_glyphs(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(length(text) // 4 + 1 AS INT) AS tokens FROM documents")
def i10_token_counts(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT vec_id, round(list_sum([x * x FOR x IN embedding::DOUBLE[]]), 5) AS squared FROM embeddings")
def i20_vector_norms(t):
    return t.embeddings.select("vec_id", F.round(X.dot(F.col("embedding"), F.col("embedding")), 5).alias("squared"))


@query()
def h1_numerals(t):
    return t.documents.select("doc_id", X.numerals(F.col("text")).alias("figures"))


@query()
def h2_unsupported_numerals(t):
    """Figures of an assistant's turn that the turns before it in the conversation lack."""
    c = t.conversations.select("conv_id", "turn", "role", X.numerals(F.col("text")).alias("f"))
    before = F.flatten(F.collect_list("f").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)))
    return c.withColumn("known", before).filter("role = 'assistant'").select("conv_id", "turn", F.array_except("f", "known").alias("unsupported"))


@query("SELECT conv_id, count(DISTINCT role) > 1 AS mixed FROM conversations GROUP BY 1")
def h5_mixed_context(t):
    return t.conversations.groupBy("conv_id").agg((F.size(F.collect_set("role")) > 1).alias("mixed"))


@query("SELECT doc_id, list_sort(list_filter(['million', 'crore', 'the', 'la'], lambda w: contains(' ' || lower(text) || ' ', ' ' || w || ' '))) AS scales FROM documents")
def h4_scales(t):
    padded = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    return t.documents.select("doc_id", F.array_sort(F.filter(F.array(*map(F.lit, ("million", "crore", "the", "la"))), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))).alias("scales"))


@query("SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS safe FROM pages")
def g16_neutralised(t):
    return t.pages.select("page_id", X.neutralised(F.col("html")).alias("safe"))


@query("SELECT doc_id, 'Document: ' || doc_id || chr(10) || coalesce('Language: ' || lang || chr(10), '') || coalesce('Source: ' || source || chr(10), '') || chr(10) || text AS enriched FROM documents")
def g13_enriched(t):
    labels = F.concat_ws("\n", F.concat(F.lit("Document: "), "doc_id"), F.concat(F.lit("Language: "), "lang"), F.concat(F.lit("Source: "), "source"))
    return t.documents.select("doc_id", F.concat(labels, F.lit("\n\n"), "text").alias("enriched"))
