"""Operators that only tests ran so far, each over a given table and with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answering, chunking, evidence, generations, reports, spatial
from ..operators import retrieval as R
from ..sources import sinks
from ..sources.shared import fresh_path
from . import path_queries as P
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

# Every document is a claim that cites the two after it; of the last ones, what they cite isn't there.


def _evidence(t):
    d = t.documents.select("doc_id", "text", "lang", "source")
    claims = d.select(F.floor(F.col("doc_id") / 4).alias("answer_id"), (F.col("doc_id") % 4).alias("claim"), F.coalesce("text", F.lit("")).alias("text"))
    cited = d.select(F.floor(F.col("doc_id") / 4).alias("answer_id"), (F.col("doc_id") % 4).alias("claim"), F.posexplode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("position", "passage_id"))
    passages = d.select(F.col("doc_id").alias("passage_id"), F.col("text").alias("span"), F.lit("").alias("issuer"), F.col("lang").alias("period"), F.col("source").alias("basis"))
    return claims, cited.withColumn("passage_id", F.col("passage_id").cast("string")), passages.withColumn("passage_id", F.col("passage_id").cast("string"))


_SCALES = "list_filter(['crore', 'lakh', 'thousand', 'million', 'billion', 'trillion'], lambda w: regexp_matches(lower({0}), '(^|[^a-z])' || w || 's?([^a-z]|$)'))"
_CURRENCIES = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z]+|[₹$€£]'), lambda w: CASE WHEN w IN ('inr', 'rs', '₹') THEN 'INR' WHEN w IN ('usd', '$') THEN 'USD' WHEN w IN ('eur', '€') THEN 'EUR' WHEN w IN ('gbp', '£') THEN 'GBP' END), lambda c: c IS NOT NULL))"
_LACKS = "list_distinct(list_filter({0}, lambda x: NOT list_contains({1}, x)))"
_CHECKED = f"""c AS (SELECT d.doc_id, coalesce(d.text, '') AS text, a.doc_id IS NULL AS no_a, b.doc_id IS NULL AS no_b, trim(coalesce(a.text, '')) <> '' AS has_a, trim(coalesce(b.text, '')) <> '' AS has_b,
  concat_ws(chr(10), CASE WHEN trim(coalesce(a.text, '')) <> '' THEN a.text END, CASE WHEN trim(coalesce(b.text, '')) <> '' THEN b.text END) AS held,
  len(list_distinct(list_filter([a.lang, b.lang], lambda x: x <> ''))) > 1 AS mixed_period, len(list_distinct(list_filter([a.source, b.source], lambda x: x <> ''))) > 1 AS mixed_basis
  FROM documents d LEFT JOIN documents a ON a.doc_id = d.doc_id + 1 LEFT JOIN documents b ON b.doc_id = d.doc_id + 2),
f AS (SELECT doc_id // 4 AS answer_id, doc_id % 4 AS claim, CAST(no_a AS INT) + CAST(no_b AS INT) AS unresolved, CAST(NOT no_a AND NOT has_a AS INT) + CAST(NOT no_b AND NOT has_b AS INT) AS textless, has_a OR has_b AS support,
  CASE WHEN has_a OR has_b THEN len({_LACKS.format(P._FIGURES.format('text'), P._FIGURES.format('held'))}) ELSE 0 END AS numerals, CASE WHEN has_a OR has_b THEN len({_LACKS.format(_SCALES.format('text'), _SCALES.format('held'))}) ELSE 0 END AS scales,
  CASE WHEN has_a OR has_b THEN len({_LACKS.format(_CURRENCIES.format('text'), _CURRENCIES.format('held'))}) ELSE 0 END AS currencies, (has_a OR has_b) AND mixed_period AS period, (has_a OR has_b) AND mixed_basis AS basis FROM c)"""


@query(f"WITH {_CHECKED} SELECT answer_id, claim, unresolved, textless, NOT support AS uncited, numerals, scales, currencies, period AS mixed_period, basis AS mixed_basis FROM f")
def h3_findings(t):
    """What the checks find against each claim, by code."""
    n = lambda code: F.size(F.filter("findings", lambda f: f["code"] == code)).alias(code)
    some = lambda code: F.exists("findings", lambda f: f["code"] == code).alias(code)
    found = evidence.findings(*_evidence(t)).select("answer_id", "claim", n("citation_not_in_evidence"), n("cited_span_has_no_text"), some("no_citation"), n("unsupported_numeral"), n("scale_not_in_cited_span"), n("currency_not_in_cited_span"), some("mixed_period"), some("mixed_basis"))
    return found.toDF("answer_id", "claim", "unresolved", "textless", "uncited", "numerals", "scales", "currencies", "mixed_period", "mixed_basis")


_DECIDED = f"""{_CHECKED}, r AS (SELECT *, unresolved + textless + numerals + scales + currencies > 0 OR NOT support AS removed FROM f),
per AS (SELECT answer_id, count(*) FILTER (NOT removed) AS released, count(*) FILTER (removed) AS withheld, coalesce(bool_or(NOT removed AND (period OR basis)), false) AS qualified,
  list_sort(list_distinct(list_filter(flatten(list([CASE WHEN unresolved > 0 THEN 'citation_not_in_evidence' END, CASE WHEN textless > 0 THEN 'cited_span_has_no_text' END, CASE WHEN NOT support THEN 'no_citation' END, CASE WHEN numerals > 0 THEN 'unsupported_numeral' END, CASE WHEN scales > 0 THEN 'scale_not_in_cited_span' END, CASE WHEN currencies > 0 THEN 'currency_not_in_cited_span' END, CASE WHEN period THEN 'mixed_period' END, CASE WHEN basis THEN 'mixed_basis' END])), lambda x: x IS NOT NULL))) AS codes FROM r GROUP BY 1),
d AS (SELECT *, answer_id % 5 <> 0 AS answerable, answer_id % 3 = 0 AS weak FROM per)"""


@query(f"""WITH {_DECIDED} SELECT answer_id, released, withheld, CASE WHEN released = 0 THEN 'abstained' WHEN withheld > 0 THEN 'partial' ELSE 'answered' END AS decision,
CASE WHEN released = 0 THEN 'none' WHEN withheld > 0 OR (qualified AND weak) THEN 'weak' WHEN qualified OR weak THEN 'moderate' ELSE 'strong' END AS support_band,
list_sort(list_distinct(list_concat(codes, list_filter([CASE WHEN NOT answerable AND released = 0 THEN 'model_reported_unanswerable' END, CASE WHEN withheld > 0 AND released = 0 THEN 'no_claim_survived_validation' END], lambda x: x IS NOT NULL)))) AS reason_codes FROM d""")
def h6_decided(t):
    """The decision, band and reasons of each answer of up to four such claims."""
    claims, cited, passages = _evidence(t)
    answers = claims.select("answer_id").distinct().select("answer_id", (F.col("answer_id") % 5 != 0).alias("answerable"), F.when(F.col("answer_id") % 3 == 0, F.array(F.lit("reranker_unavailable"))).otherwise(F.array().cast("array<string>")).alias("degraded"))
    made = evidence.decide(evidence.findings(claims, cited, passages), answers)
    return made.select("answer_id", "released", "withheld", "decision", "support_band", F.array_sort("reason_codes").alias("reason_codes"))


@query(f"WITH {_CHECKED} SELECT doc_id, len({_LACKS.format(P._FIGURES.format('text'), P._FIGURES.format('held'))}) AS figures FROM c WHERE len({_LACKS.format(P._FIGURES.format('text'), P._FIGURES.format('held'))}) > 0")
def h2_unsupported_figures(t):
    """Documents with figures that the two after them lack."""
    d = t.documents.select("doc_id", "text")
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("a")).filter("trim(coalesce(a, '')) <> ''")
    second = d.select((F.col("doc_id") - 2).alias("doc_id"), F.col("text").alias("b")).filter("trim(coalesce(b, '')) <> ''")
    lacking = F.size(X.unsupported(F.coalesce("text", F.lit("")), F.concat_ws("\n", "a", "b")))
    return d.join(following, "doc_id", "left").join(second, "doc_id", "left").select("doc_id", lacking.alias("figures")).filter("figures > 0")


_RULES = answering.RULES.replace("'", "''")
_ESCAPED = "regexp_replace({0}, '(?i)<(/?\\s*(?:passages|passage|question)\\b)', '&lt;\\1', 'g')"
_ATTRIBUTE = "replace(replace(replace(replace({0}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH p AS (SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY page_id) AS passage, html AS text, url AS issuer FROM benchmark JOIN pages ON page_id // 3 = item_id),
s AS (SELECT query_id, string_agg('<passage id="' || passage || '" issuer="' || {_ATTRIBUTE.format('issuer')} || '" period="Q<1> & ""x"">' || chr(10) || {_ESCAPED.format('text')} || chr(10) || '</passage>', chr(10) ORDER BY -passage) AS every FROM p GROUP BY 1)
SELECT query_id, '{_RULES}' || chr(10) || chr(10) || '<passages>' || chr(10) || every || chr(10) || '</passages>' || chr(10) || chr(10) || '<question>' || chr(10) || {_ESCAPED.format("trim('<question>' || text)")} || chr(10) || '</question>' AS prompt FROM s JOIN benchmark ON item_id = query_id""".replace('period="Q<1> & ""x"">', 'period="Q&lt;1&gt; &amp; &quot;x&quot;">'))
def g16_prompts(t):
    """A prompt for each benchmark text from three pages, whose markup must not pass for the prompt's own."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("<question>"), "text").alias("question"))
    pages = t.pages.select(F.floor(F.col("page_id") / 3).alias("query_id"), "page_id", F.col("html").alias("text"), F.col("url").alias("issuer"))
    own = R.ranked(pages.join(asked.select("query_id"), "query_id", "left_semi"), ["query_id"], ["page_id"], None, "passage")
    passages = own.withColumns({"shown": -F.col("passage"), "period": F.lit('Q<1> & "x"'), "basis": F.lit(" ")})
    return answering.prompts(asked, passages)


@query("""SELECT doc_id AS query_id, doc_id % 7 IN (0, 5) AS answerable, CASE WHEN doc_id % 7 IN (0, 5) THEN 1 ELSE 0 END AS claims, CASE WHEN doc_id % 7 IN (0, 5) THEN [CAST(doc_id % 9 AS INT), 2] ELSE [] END AS cited, CASE WHEN doc_id % 7 = 6 THEN 'generation_unavailable' WHEN doc_id % 7 IN (0, 4, 5) THEN NULL ELSE 'generation_contract_violated' END AS failure FROM documents""")
def g17_parsed_answers(t):
    """Answers of every form: sound, with a key too many, one missing, of another type, without claims, with text that holds JSON, and none."""
    q = lambda s: F.to_json(F.struct(s.alias("t")))
    quoted = F.expr("substring(j, 6, length(j) - 6)")
    sound = F.concat(F.lit('{"answerable": true, "claims": [{"text": '), quoted, F.lit(', "citations": ['), (F.col("doc_id") % 9).cast("string"), F.lit(", 2]}]"))
    forms = [F.concat(sound, F.lit("}")), F.concat(sound, F.lit(', "more": 1}')), F.lit('{"answerable": true}'), F.lit('{"answerable": "yes", "claims": []}'), F.lit('{"answerable": false, "claims": []}'), F.concat(sound, F.lit("}")), F.lit(None).cast("string")]
    body = F.when(F.col("doc_id") % 7 == 5, F.lit('say {"answerable": false}')).otherwise(F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    own = t.documents.select("doc_id", q(body).alias("j")).withColumn("raw", F.element_at(F.array(*forms), (F.col("doc_id") % 7 + 1).cast("int")))
    raw = own.select(F.col("doc_id").alias("query_id"), "raw", F.when(F.col("doc_id") % 7 == 6, answering.UNAVAILABLE).alias("failure"))
    parsed = answering.parse_answers(raw)
    return parsed.select("query_id", "answerable", F.size("claims").alias("claims"), F.flatten(F.transform("claims", lambda c: c["citations"])).alias("cited"), "failure")


@query("WITH n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE length(regexp_replace(b, '\\s', '', 'g')) > 0 AND NOT (regexp_matches(b, '[._]{10,}') AND (length(regexp_replace(b, '\\s', '', 'g')) - length(regexp_replace(b, '[._\\s]', '', 'g'))) / length(regexp_replace(b, '\\s', '', 'g')) >= 0.30) GROUP BY 1) SELECT doc_id, n AS blocks, 0 AS misplaced, 0 AS uncontained FROM n")
def s5_chunk_placement(t):
    """Of the chunks made of every document: its retrievable blocks, those that no child or several hold, and children that their parent's text lacks."""
    blocks = R.blocks(t.documents).select("doc_id", "ordinal", F.concat_ws(":", "doc_id", "ordinal").alias("element_id"), "text", F.floor(F.col("ordinal") / 20).cast("int").alias("page_number"), F.when(F.col("ordinal") % 7 == 6, F.lit("r")).alias("region_id"))
    return chunking.placement(blocks, chunking.chunked(blocks))


# A log of generations from `events`: a user is a generation, five versions, the last one of each opened as a shadow.
_LOG = "SELECT CAST(user_id AS VARCHAR) AS generation_id, 'v' || user_id % 5 AS version_id, CASE WHEN user_id = max(user_id) OVER (PARTITION BY user_id % 5) THEN 'shadow' WHEN user_id = min(user_id) OVER (PARTITION BY user_id % 5) THEN 'active' ELSE 'superseded' END AS state, n AS seq FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


def _log(t):
    own = t.events.groupBy("user_id").agg(F.count("*").alias("seq"))
    ends = own.groupBy((F.col("user_id") % 5).alias("v")).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    both = own.withColumn("v", F.col("user_id") % 5).join(ends, "v")
    state = F.when(F.col("user_id") == F.col("hi"), "shadow").when(F.col("user_id") == F.col("lo"), "active").otherwise("superseded")
    return both.select(F.col("user_id").cast("string").alias("generation_id"), F.concat(F.lit("v"), "v").alias("version_id"), F.lit("r").alias("run_id"), F.lit("1").alias("config"), state.alias("state"), "seq")


@query(f"WITH l AS ({_LOG}), s AS (SELECT generation_id, version_id FROM l WHERE state = 'shadow' ORDER BY CAST(generation_id AS BIGINT) DESC LIMIT 1), n AS (SELECT max(seq) + 1 AS seq FROM l) SELECT generation_id, 'active' AS state, n.seq FROM s, n UNION ALL SELECT l.generation_id, 'superseded', n.seq FROM l JOIN s USING (version_id), n WHERE l.state = 'active'")
def j2_activated(t):
    """The events that making the newest shadow active appends: its own, and that of the one it supersedes."""
    log = _log(t)
    newest = log.filter("state = 'shadow'").agg(F.max(F.col("generation_id").cast("long"))).first()[0]
    return generations.activate(log, str(newest)).select("generation_id", "state", "seq")


@query(f"WITH l AS ({_LOG}), p AS (SELECT CAST(user_id AS VARCHAR) AS generation_id FROM events) SELECT count(*) AS points_before, count(*) FILTER (state = 'superseded') AS points_prunable, count(*) FILTER (state = 'superseded') AS removed, count(*) FILTER (state <> 'superseded') AS points_after, count(*) FILTER (state = 'active') AS active_before, (SELECT count(*) FROM l WHERE state = 'superseded') AS generations FROM p JOIN l USING (generation_id)")
def j8_pruned(t):
    """An index of `events` from which superseded generations are pruned, counted before and after."""
    at = fresh_path(t.spark, "points")
    # a folder a generation would be one a user: the ids stay a column that files are sorted by
    t.events.select(F.col("user_id").cast("string").alias("generation_id"), "event_id").repartition("generation_id").sortWithinPartitions("generation_id").write.parquet(at)
    told = generations.prune(t.spark, _log(t), at, confirm=True)
    row = (told.points_before, told.points_prunable, told.removed, told.points_after, told.active_before, len(told.prunable))
    return t.spark.createDataFrame([row], "points_before long, points_prunable long, removed long, points_after long, active_before long, generations long")


@query(f"WITH l AS ({_LOG}) SELECT count(*) FILTER (event_type <> 'purchase') AS points, count(*) AS children, count(*) FILTER (event_type = 'purchase') = 0 AS agree FROM events JOIN l ON generation_id = CAST(user_id AS VARCHAR) WHERE state = 'active'")
def d29_active_points(t):
    """Children of active generations against their points, some of which are missing."""
    rows = t.events.select(F.col("user_id").cast("string").alias("generation_id"), F.lit("child").alias("role"), "event_type")
    return generations.index_consistency(_log(t), rows, rows.filter("event_type <> 'purchase'"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bad FROM orders) WHERE bad")
def b7_late_orders(t):
    """Orders dated before the one numbered before them of the same customer."""
    return reports.out_of_order(t.orders, "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey")


@query("SELECT d.doc_id, min(k.doc_id) AS cached FROM documents d JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) k ON d.text = k.text GROUP BY 1")
def c15_copies_found(t):
    """Documents whose text is that of a labelled one, and the first such."""
    known = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("cached"), "text")
    return reports.cache_hits(t.documents.select("doc_id", "text"), known).groupBy("doc_id").agg(F.min("cached").alias("cached"))


_BANDS = "SELECT DISTINCT user_id % 50 AS page, event_id % 97 * 10 AS top, event_id % 97 * 10 + 6 AS bottom, 2 + event_id % 2 AS members FROM events WHERE event_id % 97 < 50"
_REGIONS = "SELECT s_suppkey AS region, s_suppkey % 50 AS page, s_suppkey * 13 % 900 AS r0, s_suppkey * 13 % 900 + 1 AS r1 FROM supplier"


@query(f"WITH b AS ({_BANDS}), r AS ({_REGIONS}) SELECT region FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.page = r.page) AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = r.page AND NOT (bottom < r0 OR top > r1))")
def c12_regions_without_rules(t):
    """Regions on ruled pages that no band of rules meets."""
    b = t.events.filter("event_id % 97 < 50").selectExpr("user_id % 50 AS page", "event_id % 97 * 10 AS top", "event_id % 97 * 10 + 6 AS bottom", "2 + event_id % 2 AS members").distinct()
    r = t.supplier.selectExpr("s_suppkey AS region", "s_suppkey % 50 AS page", "s_suppkey * 13 % 900 AS r0", "s_suppkey * 13 % 900 + 1 AS r1")
    return spatial.unsupported(r, b, ["page"]).select("region")


@query("SELECT vec_id, list_transform(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum([y * y FOR y IN embedding::DOUBLE[]]))), lambda x: round(x, 5) + 0e0) AS unit FROM embeddings")
def i20_unit_vectors(t):
    return t.embeddings.select("vec_id", F.transform(X.unit_vector(F.col("embedding")), lambda x: F.round(x, 5) + F.lit(0.0)).alias("unit"))


@query("SELECT p.page_id, blocks = 0 AND tables = 0 AS yielded_nothing, chars > 0 AS text_bearing, images > 0 AND chars = 0 AS image_only, CASE WHEN blocks = 0 AND tables = 0 AND images > 0 AND chars = 0 THEN 'image_only_page' WHEN blocks = 0 AND tables = 0 THEN 'no_content_extracted' END AS gap FROM (SELECT page_id, page_id % 3 AS blocks, page_id % 2 AS tables, page_id % 5 AS images, CASE WHEN page_id % 4 = 0 THEN 0 ELSE length(html) END AS chars FROM pages) p")
def b14_page_signals(t):
    own = t.pages.select("page_id", (F.col("page_id") % 3).alias("blocks"), (F.col("page_id") % 2).alias("tables"), (F.col("page_id") % 5).alias("images"), F.when(F.col("page_id") % 4 == 0, 0).otherwise(F.length("html")).alias("chars"))
    return spatial.page_signals(own).select("page_id", "yielded_nothing", "text_bearing", "image_only", "gap")


@query("WITH e AS (SELECT user_id % 40 AS page, event_id % 61 AS x0, event_id % 61 + event_id % 90 AS x1, event_id % 83 AS y0, event_id % 83 + event_id % 5 AS y1 FROM events) SELECT page, list_sort(list_distinct(list(round((y0 + y1) / 2e0, 1)))) AS rules FROM e WHERE abs(y1 - y0) <= 3 AND abs(x1 - x0) >= 40 GROUP BY 1")
def a17_rules(t):
    own = t.events.selectExpr("user_id % 40 AS page", "event_id % 61 AS x0", "event_id % 61 + event_id % 90 AS x1", "event_id % 83 AS y0", "event_id % 83 + event_id % 5 AS y1")
    return spatial.rules(own, ["page"])


@query("SELECT c.event_id AS cell, min(s.sx0) AS text_left FROM (SELECT event_id, user_id AS page, event_id % 50 * 1e0 AS x0, event_id % 50 + 9e0 AS x1, event_id % 40 * 1e0 AS y0, event_id % 40 + 8e0 AS y1 FROM events WHERE event_type = 'click') c JOIN (SELECT user_id AS page, event_id % 53 * 1e0 AS sx0, event_id % 53 + 3e0 AS sx1, event_id % 43 * 1e0 AS sy0, event_id % 43 + 2e0 AS sy1 FROM events WHERE event_type <> 'click') s USING (page) WHERE (sx0 + sx1) / 2 BETWEEN x0 AND x1 AND (sy0 + sy1) / 2 BETWEEN y0 AND y1 GROUP BY 1")
def c11_text_left(t):
    """Of the spans whose centre lies in a cell, where the first begins."""
    cells = t.events.filter("event_type = 'click'").selectExpr("event_id AS cell", "user_id AS page", "event_id % 50 * 1D AS x0", "event_id % 50 + 9D AS x1", "event_id % 40 * 1D AS y0", "event_id % 40 + 8D AS y1")
    spans = t.events.filter("event_type <> 'click'").selectExpr("user_id AS page", "event_id % 53 * 1D AS sx0", "event_id % 53 + 3D AS sx1", "event_id % 43 * 1D AS sy0", "event_id % 43 + 2D AS sy1")
    return spatial.leftmost_text(spans, cells, ["page"], "cell")


@query("SELECT DISTINCT d.doc_id AS element_id, d.text FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND d.text IS NOT NULL")
def c19_texts(t):
    """The texts of the labelled documents of quality."""
    return answering.text_for(t.documents.select(F.col("doc_id").alias("element_id"), "text"), t.labels.filter("quality = 1").select(F.col("doc_id").alias("element_id")))


@query(f"WITH l AS ({_LOG}) SELECT count(*) AS points FROM events JOIN l ON generation_id = CAST(user_id AS VARCHAR) WHERE state = 'active' AND event_type IN ('click', 'view') AND year(ts) BETWEEN 2000 AND 2100 AND value >= 10")
def d13_filtered_points(t):
    """Points of active generations that meet a list, a year and a range open above."""
    points = t.events.select(F.col("user_id").cast("string").alias("generation_id"), "event_type", F.year("ts").alias("fiscal_year"), "value")
    n = R.filtered_count(points, generations.active_ids(_log(t)), {"event_type": ["click", "view"], "fiscal_year": (2000, 2100), "value": (10.0, None), "issuer": None})
    return t.spark.createDataFrame([(n,)], "points long")


@query("SELECT DISTINCT o_orderkey AS answer_id, CASE WHEN o_custkey % 3 = 0 THEN 'abstained' ELSE 'answered' END AS decision, o_custkey % 3 AS released FROM orders")
def a28_answers_added_once(t):
    """Decided answers written twice, and read back."""
    at = fresh_path(t.spark, "answers")
    rows = t.orders.select(F.col("o_orderkey").alias("answer_id"), F.when(F.col("o_custkey") % 3 == 0, "abstained").otherwise("answered").alias("decision"), (F.col("o_custkey") % 3).alias("released"))
    claims = t.lineitem.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("claim_index"))
    for _ in range(2):
        sinks.record_answers(rows, claims.distinct(), at)
    return t.spark.read.parquet(f"{at}/answers")
