"""Table structure, layout, evidence and consistency queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as X
from ..operators import evidence, reports, sections, spatial, tables
from ..operators import retrieval as R
from . import retrieval_queries
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

_CELLS = """SELECT table_id, r, c, CASE c WHEN 0 THEN a WHEN 1 THEN b ELSE d END AS text FROM (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r,
CASE l_partkey % 5 WHEN 0 THEN 'Total' WHEN 1 THEN '' WHEN 2 THEN '(Rs in crore)' ELSE l_returnflag END AS a, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE l_linestatus END AS b, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS d FROM lineitem), (VALUES (0), (1), (2)) AS v(c)"""


def _cells(t):
    """Order lines as grids of three columns, with labels, totals, unit rows and gaps."""
    # by the name that what follows is partitioned by: under another Spark would shuffle the cells again
    w = Window.partitionBy("table_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    texts = F.expr("array(CASE l_partkey % 5 WHEN 0 THEN 'Total' WHEN 1 THEN '' WHEN 2 THEN '(Rs in crore)' ELSE l_returnflag END, IF(l_suppkey % 3 = 0, '', l_linestatus), IF(l_partkey % 7 = 0, '', CAST(l_linenumber AS string)))")
    rows = t.lineitem.withColumnRenamed("l_orderkey", "table_id").select("table_id", (F.row_number().over(w) - 1).alias("r"), texts.alias("ts"))
    return rows.select("table_id", "r", F.posexplode("ts").alias("c", "text")).withColumn("present", F.col("text") != "")


_ROLES = f"""x AS ({_CELLS}), s AS (SELECT table_id, r, bool_or(text = '(Rs in crore)') AS u, bool_or(c = 0 AND text <> '') AS l, bool_or(c > 0 AND text <> '') AS b, max(CASE WHEN c = 0 THEN text END) AS label FROM x GROUP BY 1, 2),
h AS (SELECT *, NOT u AND l AND NOT b AS sec, (r = 0 AND count(*) OVER (PARTITION BY table_id) > 1) OR (NOT l AND b) AS hl FROM s),
k AS (SELECT *, NOT u AND NOT sec AND hl AND NOT coalesce(bool_or(NOT u AND (sec OR NOT hl)) OVER (PARTITION BY table_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS head FROM h)"""


@query(f"WITH x AS ({_CELLS}) SELECT table_id, r, c, CASE WHEN text <> '' THEN coalesce(min(CASE WHEN text <> '' THEN c END) OVER (PARTITION BY table_id, r ORDER BY c ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 3) - c END AS column_span, CASE WHEN text <> '' THEN coalesce(min(CASE WHEN text <> '' THEN r END) OVER (PARTITION BY table_id, c ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), max(r) OVER (PARTITION BY table_id) + 1) - r END AS row_span FROM x")
def e10_cell_spans(t):
    return tables.with_spans(_cells(t)).select("table_id", "r", "c", "column_span", "row_span")


@query(f"WITH {_ROLES} SELECT table_id, r, u AS is_units, sec AS is_section, head AS is_header, NOT head AND NOT u AND label = 'Total' AS is_total FROM k")
def e12_row_roles(t):
    return tables.row_roles(_cells(t)).select("table_id", "r", "is_units", "is_section", "is_header", "is_total")


@query(f"WITH {_ROLES}, p AS (SELECT x.*, k.head FROM x JOIN k USING (table_id, r)) SELECT table_id, count(*) FILTER (text <> '') AS texts, round(coalesce(count(*) FILTER (text <> '' AND NOT head AND regexp_matches(text, '^[0-9]+$')) / nullif(count(*) FILTER (text <> '' AND NOT head), 0), 0), 4) AS numeric_ratio, CASE WHEN count(*) FILTER (text <> '') = 0 OR max(r) < 1 THEN 'rejected' ELSE 'accepted' END AS verdict FROM p GROUP BY 1")
def d14_table_quality(t):
    return tables.assess(tables.derive(_cells(t))).select("table_id", "texts", "numeric_ratio", "verdict")


@query()
def i27_derived_tables(t):
    return tables.derive(_cells(t))


@query(f"WITH x AS ({_CELLS}) SELECT table_id, r, string_agg(text, ' ' ORDER BY c) AS line FROM x WHERE text <> '' GROUP BY 1, 2")
def i14_joined_words(t):
    words = _cells(t).filter("present").groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("ws"))
    return words.select("table_id", "r", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"))


@query(f"WITH x AS ({_CELLS}) SELECT table_id, count(*) = (max(r) + 1) * (max(c) + 1) AND count(*) = count(DISTINCT r * 3 + c) AS sound FROM x GROUP BY 1")
def i26_grid_contract(t):
    n = F.count("*")
    return _cells(t).groupBy("table_id").agg(((n == (F.max("r") + 1) * (F.max("c") + 1)) & (n == F.countDistinct("r", "c"))).alias("sound"))


@query(f"WITH x AS ({_CELLS}) SELECT table_id, r, c, printf('p. %d, table %d, R%dC%d', (table_id % 9)::BIGINT, (table_id % 3)::BIGINT, r + 1, c + 1) AS locator FROM x")
def i11_locators(t):
    return _cells(t).select("table_id", "r", "c", L.cell_locator(F.col("table_id") % 9, F.col("table_id") % 3, F.col("r"), F.col("c")).alias("locator"))


@query(f"WITH x AS ({_CELLS}) SELECT table_id, r, c, regexp_matches(text, '^[0-9]+$') AS numeric, text = '(Rs in crore)' AS units, CASE WHEN text = 'Total' THEN 'total' END AS total FROM x")
def b9_cell_predicates(t):
    x = F.col("text")
    return _cells(t).select("table_id", "r", "c", X.looks_numeric(x).alias("numeric"), X.states_units(x).alias("units"), X.total_word(x).alias("total"))


@query("SELECT event_id FROM (SELECT event_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) WHERE bad")
def b7_order_violations(t):
    return reports.out_of_order(t.events, "user_id", "event_id", "ts").select("event_id")


_POINTS = "SELECT event_id, user_id % 50 AS page, event_id % 97 AS y FROM events"
_AREAS = "SELECT s_suppkey AS region, s_suppkey % 50 AS page, s_suppkey * 13 % 90 AS r0, s_suppkey * 13 % 90 + 20 + s_suppkey % 11 AS r1 FROM supplier"


@query(f"WITH p AS ({_POINTS}), a AS ({_AREAS}) SELECT event_id, region FROM (SELECT event_id, region, row_number() OVER (PARTITION BY event_id ORDER BY r1 - r0, region) AS n FROM p LEFT JOIN a ON p.page = a.page AND y BETWEEN r0 AND r1) WHERE n = 1")
def c10_smallest_box(t):
    """Points to the smallest box that holds them; null where none does."""
    p = t.events.selectExpr("event_id", "user_id % 50 AS page", "event_id % 97 AS y")
    a = t.supplier.selectExpr("s_suppkey AS region", "s_suppkey % 50 AS page", "s_suppkey * 13 % 90 AS r0", "s_suppkey * 13 % 90 + 20 + s_suppkey % 11 AS r1")
    return spatial.smallest_box(p, a, ["page"], "event_id", "region", F.expr("y BETWEEN r0 AND r1"), F.expr("r1 - r0"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON sha256(d.text) = sha256(b.text) AND d.text = b.text")
def c15_cache_hits(t):
    """A digest only finds; the text itself decides."""
    return reports.cache_hits(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text")).select("doc_id", "item_id")


_TOP = f"{retrieval_queries._POST}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ordinal) AS rank FROM s) WHERE rank <= 5)"


@query(f"WITH {_TOP} SELECT query_id, top.doc_id, ordinal, rank, d.source, l.quality FROM top JOIN documents d ON top.doc_id = d.doc_id LEFT JOIN labels l ON top.doc_id = l.doc_id")
def c17_assembled_results(t):
    """Text and metadata are joined only to what the search returns."""
    hits = retrieval_queries.QUERIES["g3_bm25_search"](t.spark, t.folder).drop("score")
    return hits.join(t.documents.select("doc_id", "source"), "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("query_id", "doc_id", "ordinal", "rank", "source", "quality")


@query(f"WITH {_TOP}, y AS (SELECT query_id, rank, CASE WHEN length(b.text) < 170 THEN 'd' || top.doc_id ELSE 'b' || top.doc_id || '.' || top.ordinal END AS passage_id FROM top JOIN b ON top.doc_id = b.doc_id AND top.ordinal = b.ordinal) SELECT query_id, passage_id, min(rank) AS best_rank, count(*) AS hits FROM y GROUP BY 1, 2")
def g14_parent_expansion(t):
    """Fragments are shown as their document; hits on one passage merge."""
    name = F.concat(F.lit("b"), "doc_id", F.lit("."), "ordinal")
    hits = retrieval_queries.QUERIES["g3_bm25_search"](t.spark, t.folder).join(R.blocks(t.documents).select("doc_id", "ordinal", "text"), ["doc_id", "ordinal"])
    hits = hits.withColumn("chunk_id", name)
    parents = hits.select("chunk_id", "doc_id").distinct().join(t.documents.select("doc_id", F.col("text").alias("parent_text")), "doc_id").select("chunk_id", F.concat(F.lit("d"), "doc_id").alias("parent_id"), "parent_text")
    return evidence.expand(hits.select("query_id", "chunk_id", "rank", "text"), parents).select("query_id", "passage_id", "best_rank", F.size("stands_for").cast("long").alias("hits"))


@query()
def h3_claim_findings(t):
    """Assistant turns as claims that cite the turn before them, and each seventh also one that isn't there."""
    claims, cited, passages = _claims(t)
    return evidence.findings(claims, cited, passages)


@query()
def h6_decisions(t):
    claims, cited, passages = _claims(t)
    answers = claims.select("answer_id").distinct().select("answer_id", F.lit(True).alias("answerable"), F.array().cast("array<string>").alias("degraded"))
    return evidence.decide(evidence.findings(claims, cited, passages), answers)


def _claims(t):
    c = t.conversations.withColumn("passage_id", F.concat_ws(":", "conv_id", "turn"))
    said = c.filter("role = 'assistant'")
    claims = said.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), "text")
    extra = F.when(F.col("conv_id") % 7 == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    cited = said.select("conv_id", "turn", F.posexplode(F.concat(F.array((F.col("turn") - 1).cast("int")), extra)).alias("position", "other"))
    cited = cited.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("claim"), "position", F.concat_ws(":", "conv_id", "other").alias("passage_id"))
    return claims, cited, c.select("passage_id", F.col("text").alias("span"), F.col("role").alias("issuer"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("basis"))


@query("SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag = 'N') AS accepted FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1")
def c20_verdicts(t):
    lines = reports.within(t.lineitem, t.part.filter("p_size > 10"), "l_partkey", "p_partkey")
    return reports.counts(lines, ["l_partkey"], rejected=F.col("l_returnflag") == "R", accepted=F.col("l_returnflag") == "N").drop("total")


@query("SELECT source, count(*) AS scored, count(*) FILTER (quality = 1 AND toxic = 0) AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def d28_agreement(t):
    return reports.agreement(t.documents.select("doc_id", "source"), t.labels, "doc_id", "source", (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("SELECT (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS consistent")
def d29_index_consistency(t):
    return t.documents.agg((F.count("*") == F.countDistinct("doc_id")).alias("consistent"))


@query("SELECT count(*) AS documents, sum(n_chars) AS chars, count(*) FILTER (text IS NULL OR text = '') AS unreadable FROM documents")
def d30_headline(t):
    return reports.headline(t.documents, "n_chars", F.col("text").isNull() | (F.col("text") == ""))


@query("SELECT user_id, greatest(count(*) - 3 - count(*) FILTER (event_type = 'click'), 0) AS dropped, arg_max(event_type, struct_pack(v := value, e := event_id)) AS slowest FROM events GROUP BY 1")
def d31_funnel(t):
    return reports.funnel(t.events, "user_id", 3, F.col("event_type") == "click", "event_type", ["value", "event_id"])


@query("SELECT conv_id, turn, sum(c::int) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT conv_id, turn, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))")
def e18_grouped_claims(t):
    return sections.runs_of(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").select("conv_id", "turn", "run")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id % 97, event_id % 13, event_id) - 1 AS ordinal FROM events")
def f1_reading_order(t):
    """Down the page, then across it."""
    own = t.events.selectExpr("event_id", "user_id % 50 AS page", "event_id % 97 AS y0", "event_id % 13 AS x0")
    return spatial.reading_order(own, ["page"], ["y0", "x0", "event_id"]).select("event_id", "ordinal")


@query("SELECT page, kind, id, row_number() OVER (PARTITION BY page ORDER BY y, kind, id) - 1 AS ordinal FROM (SELECT user_id % 50 AS page, 'block' AS kind, event_id AS id, event_id % 97 AS y FROM events UNION ALL SELECT s_suppkey % 50, 'table', s_suppkey, s_suppkey * 13 % 90 FROM supplier)")
def f2_interleaved(t):
    blocks = t.events.selectExpr("user_id % 50 AS page", "'block' AS kind", "event_id AS id", "event_id % 97 AS y")
    tables_ = t.supplier.selectExpr("s_suppkey % 50 AS page", "'table' AS kind", "s_suppkey AS id", "s_suppkey * 13 % 90 AS y")
    return spatial.interleaved(blocks, tables_, ["page"], ["y", "kind", "id"]).select("page", "kind", "id", "ordinal")


@query("SELECT user_id, list(event_type ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def s1_ordered_distinct(t):
    """Distinct values in the order of their first occurrence."""
    return reports.ordered_distinct(t.events, ["user_id"], "event_type", "event_id", "kinds")


@query(f"SELECT doc_id, count(*) FILTER (NOT contains(d.text, b.text)) AS outside FROM ({retrieval_queries._BLOCKS}) b JOIN documents d USING (doc_id) GROUP BY 1")
def s6_contained(t):
    """Every block lies in its document's text."""
    lines = F.split("text", "\n")
    outside = F.size(F.filter(lines, lambda x: ~F.contains(F.col("text"), x))).cast("long")  # within the row: the text is not joined to its own lines
    return t.documents.filter("text IS NOT NULL").groupBy("doc_id").agg(F.sum(outside).alias("outside"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS times FROM documents GROUP BY text")
def s7_batch_dedupe(t):
    """Each different text once, with the place of its first and the number of all."""
    return reports.batch_dedupe(t.documents.select("doc_id", "text"), "doc_id").select("digest", "first_id", "times")


_BOX = "SELECT event_id, CAST(event_id % 4 * 90 AS INT) AS rot, (event_id % 97)::DOUBLE AS x0, (event_id % 89)::DOUBLE AS y0, (event_id % 97 + 30)::DOUBLE AS x1, (event_id % 89 + 10)::DOUBLE AS y1 FROM events"


@query(f"SELECT event_id, CASE rot WHEN 0 THEN x0 WHEN 90 THEN 792 - y1 WHEN 180 THEN 612 - x1 ELSE y0 END AS left_x, CASE rot WHEN 0 THEN y0 WHEN 90 THEN x0 WHEN 180 THEN 792 - y1 ELSE 612 - x1 END AS top_y FROM ({_BOX})")
def i13_displayed_boxes(t):
    b = t.events.selectExpr("event_id", "CAST(event_id % 4 * 90 AS INT) AS rot", "CAST(event_id % 97 AS DOUBLE) AS x0", "CAST(event_id % 89 AS DOUBLE) AS y0", "CAST(event_id % 97 + 30 AS DOUBLE) AS x1", "CAST(event_id % 89 + 10 AS DOUBLE) AS y1")
    box = b.select("event_id", L.displayed(F.struct("x0", "y0", "x1", "y1"), F.col("rot"), F.lit(612.0), F.lit(792.0)).alias("d"))
    return box.select("event_id", F.col("d.x0").alias("left_x"), F.col("d.y0").alias("top_y"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def i16_decoded(t):
    """Malformed input decodes to null."""
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM events")
def i25_durations(t):
    return reports.durations(t.events, "user_id", "ts", ["ts", "event_id"]).select("event_id", "micros")


@query("SELECT user_id, count(*) AS attempts, max_by(event_type, event_id) AS state FROM events GROUP BY 1")
def j6_attempts(t):
    """Attempts counted, and the last event's state, from the log."""
    return reports.attempts(t.events, "user_id", "event_type", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def j9_pruned_cache(t):
    return t.events.filter(reports.since_last(t.events, "ts", 7)).select("event_id")
