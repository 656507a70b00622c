"""Facts and their conflicts, measures over periods, names in texts, regions, row groups, and how good ranked lists are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, ledger, metrics, resolution, tables
from ..operators import retrieval as R
from . import retrieval_queries as Q
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)

#: A label and what is displayed after it: a figure, or a sign for none.
_MENTION = r"(\p{L}+):? +([(]?[-−–]?[0-9][0-9,]*(?:[.][0-9]+)?[)]?|[-–—]|n/a|nil)(?: |\n|$)"
_MENTION_SQL = _MENTION.replace(r"\p{L}", r"\pL")


def _facts(t):
    """What documents display after a word, by source and that word, with where it stands."""
    whole = F.regexp_extract_all("text", F.lit(f"({_MENTION})"), F.lit(1))
    found = t.documents.select("doc_id", "source", F.posexplode(whole).alias("position", "m"))
    part = lambda i: F.regexp_extract("m", f"^{_MENTION}", i)
    return ledger.facts(found.select("doc_id", "source", "position", F.lower(part(1)).alias("concept"), part(2).alias("displayed")))


_FACTS = f"""m AS (SELECT doc_id, source, unnest(range(len(ms))) AS position, unnest(ms) AS m FROM (SELECT doc_id, source, regexp_extract_all(text, '{_MENTION_SQL}') AS ms FROM documents)),
d AS (SELECT doc_id, source, CAST(position AS INT) AS position, lower(regexp_extract(m, '{_MENTION_SQL}', 1)) AS concept, regexp_extract(m, '{_MENTION_SQL}', 2) AS displayed FROM m),
p AS (SELECT *, replace(regexp_replace(displayed, '[(),−–-]', '', 'g'), ',', '') AS digits, (displayed LIKE '(%' AND displayed LIKE '%)') OR regexp_matches(displayed, '^[(]?[-−–]') AS negative FROM d),
v AS (SELECT *, CASE WHEN regexp_matches(digits, '^[0-9]+([.][0-9]+)?$') AND length(ltrim(regexp_extract(digits, '^([0-9]+)', 1), '0')) <= 28 AND length(rtrim(regexp_extract(digits, '[.]([0-9]+)$', 1), '0')) <= 10 THEN CAST(digits AS DECIMAL(38, 10)) * CASE WHEN negative THEN -1 ELSE 1 END END AS amount FROM p),
f AS (SELECT doc_id, source, position, concept, displayed, CASE WHEN displayed IN ('-', '–', '—', 'nil') THEN 'nil' WHEN displayed = 'n/a' THEN 'not_applicable' WHEN amount IS NULL THEN 'parse_failure' WHEN amount = 0 THEN 'zero' ELSE 'numeric' END AS state, amount AS value, length(regexp_extract(displayed, '[.]([0-9]+)', 1)) AS places FROM v)"""


@query(f"WITH {_FACTS} SELECT doc_id, source, position, concept, displayed, state, CAST(value AS DOUBLE) AS value, places FROM f")
def n1_facts(t):
    return _facts(t).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_FACTS} SELECT state, count(*) AS facts, count(value) AS with_value, count(DISTINCT concept) AS concepts FROM f GROUP BY 1")
def n2_value_states(t):
    return _facts(t).groupBy("state").agg(F.count("*").alias("facts"), F.count("value").alias("with_value"), F.count_distinct("concept").alias("concepts"))


@query(f"""WITH {_FACTS}, g AS (SELECT concept, count(*) AS facts, count(DISTINCT value) AS "values", min(value) AS least, max(value) AS greatest, min(abs(value)) AS small, max(abs(value)) AS large, min(places) AS places FROM f WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT value) > 1),
k AS (SELECT *, CASE WHEN small = large THEN 'sign' WHEN "values" = 2 AND small > 0 AND log10(CAST(large AS DOUBLE) / CAST(small AS DOUBLE)) >= 1 AND abs(log10(CAST(large AS DOUBLE) / CAST(small AS DOUBLE)) - round(log10(CAST(large AS DOUBLE) / CAST(small AS DOUBLE)))) < 1e-12 THEN 'scale' WHEN floor(CAST(least AS DOUBLE) * pow(10e0, places) + 5e-1) = floor(CAST(greatest AS DOUBLE) * pow(10e0, places) + 5e-1) THEN 'rounding' ELSE 'value' END AS kind FROM g)
SELECT concept, facts, "values", CAST(least AS DOUBLE) AS least, CAST(greatest AS DOUBLE) AS greatest, kind, kind <> 'rounding' AS material FROM k""")
def n3_fact_conflicts(t):
    """Words that documents state different figures for."""
    found = ledger.conflicts(_facts(t), ["concept"])
    return found.withColumns({c: F.col(c).cast("double") for c in ("least", "greatest")})


#: Orders finished count against those that are not, so that amounts change sign.
_FLOWS = """m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS period, sum(CAST(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2))) AS amount, count(*) AS orders FROM orders GROUP BY 1, 2)"""


def _flows(t):
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(18,2)")
    period = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return t.orders.groupBy("o_custkey", period.alias("period")).agg(F.sum(signed).alias("amount"), F.count("*").alias("orders"))


@query(f"""WITH {_FLOWS}, l AS (SELECT *, lag(amount) OVER w AS previous, lag(period) OVER w AS before FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY period)),
g AS (SELECT *, CASE WHEN before IS NULL THEN 'no_previous' WHEN period - before <> 1 THEN 'period_gap' WHEN amount IS NULL OR previous IS NULL THEN 'missing' WHEN previous = 0 THEN 'zero_base' WHEN (amount > 0 AND previous < 0) OR (amount < 0 AND previous > 0) THEN 'sign_change' END AS guard FROM l)
SELECT o_custkey, period, CAST(amount AS DOUBLE) AS amount, CAST(previous AS DOUBLE) AS previous, guard, CASE WHEN guard IS NULL THEN sign(amount - previous) * CAST((abs(CAST((amount - previous) * 100 AS HUGEINT)) * 2000000 + abs(CAST(previous * 100 AS HUGEINT))) // (2 * abs(CAST(previous * 100 AS HUGEINT))) AS DOUBLE) / 1e6 END AS growth FROM g""")
def n4_period_growth(t):
    """Growth from month to month of each customer's balance of orders."""
    made = ledger.growth(_flows(t), ["o_custkey"], "period", "amount")
    return made.select("o_custkey", "period", F.col("amount").cast("double").alias("amount"), F.col("previous").cast("double").alias("previous"), "guard", F.col("growth").cast("double").alias("growth"))


@query(f"""WITH {_FLOWS}, e AS (SELECT o_custkey, min(period) AS first, max(period) AS last, arg_min(amount, period) AS opening, arg_max(amount, period) AS closing FROM m GROUP BY 1),
g AS (SELECT *, CASE WHEN opening IS NULL OR closing IS NULL THEN 'missing' WHEN first = last THEN 'one_period' WHEN opening <= 0 OR closing <= 0 THEN 'not_positive' END AS guard FROM e)
SELECT o_custkey, first, last, guard, CASE WHEN guard IS NULL THEN round(pow(CAST(closing AS DOUBLE) / CAST(opening AS DOUBLE), 1e0 / (last - first)) - 1e0, 6) END AS cagr FROM g""")
def n4_compound_growth(t):
    return ledger.compound_growth(_flows(t), ["o_custkey"], "period", "amount").select("o_custkey", "first", "last", "guard", F.round("cagr", 6).alias("cagr"))


@query("""WITH s AS (SELECT l_partkey, sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18, 2))) AS returned, sum(CAST(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS DECIMAL(18, 2))) AS stayed, count(DISTINCT l_linestatus) = 1 AS alike FROM lineitem GROUP BY 1),
g AS (SELECT *, CASE WHEN NOT alike THEN 'unlike_basis' WHEN stayed = 0 THEN 'zero_denominator' END AS guard FROM s)
SELECT l_partkey, guard, CASE WHEN guard IS NULL THEN round(CAST(returned AS DOUBLE) / CAST(stayed AS DOUBLE), 6) END AS ratio FROM g""")
def n4_guarded_ratio(t):
    """Returned against kept quantity of each part, where all its lines are of one status."""
    part = lambda keep: F.sum(F.when(keep, F.col("l_quantity")).otherwise(0).cast("decimal(18,2)"))
    sums = t.lineitem.groupBy("l_partkey").agg(part(F.col("l_returnflag") == "R").alias("a"), part(F.col("l_returnflag") != "R").alias("b"), (F.count_distinct("l_linestatus") == 1).alias("alike"))
    made = sums.withColumn("x", ledger.ratio(F.col("a"), F.col("b"), {"basis": F.col("alike")}))
    return made.select("l_partkey", "x.guard", F.col("x.value").cast("double").alias("ratio"))


_WORDS = "regexp_extract_all(lower({0}), '[\\pL\\pM]+|\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?')"


@query(f"""WITH a AS (SELECT array_to_string({_WORDS.format('text')}[1:2], ' ') AS alias, item_id FROM benchmark), n AS (SELECT alias, list_sort(list(DISTINCT item_id)) AS entities FROM a WHERE alias <> '' GROUP BY 1),
d AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS w FROM documents)
SELECT doc_id, alias, entities, CASE WHEN len(entities) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM d JOIN n ON contains(w, ' ' || alias || ' ')""")
def n6_resolved_names(t):
    """The benchmark's items are named by their first two words; which of these names each document holds, and what they may stand for."""
    words = F.array_join(F.slice(resolution.analysis.words(F.col("text")), 1, 2), " ")
    return resolution.resolve(t.documents, t.benchmark.select(words.alias("alias"), F.col("item_id").alias("entity")), "doc_id")


_HITS = "b AS (SELECT doc_id, unnest(range(len(ls))) AS ordinal, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


@query(f"""WITH {_HITS}, h AS (SELECT doc_id, ordinal FROM b WHERE regexp_matches(text, '[0-9]')), x AS (SELECT doc_id, min(ordinal) AS low, max(ordinal) AS high FROM b GROUP BY 1),
i AS (SELECT *, CASE WHEN ordinal - lag(ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal) <= 5 THEN 0 ELSE 1 END AS new FROM h), j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal) AS island FROM i)
SELECT doc_id, CAST(greatest(min(ordinal) - 2, any_value(low)) AS INT) AS first, CAST(least(max(ordinal) + 2, any_value(high)) AS INT) AS last, count(*) AS hits FROM j JOIN x USING (doc_id) GROUP BY doc_id, island""")
def n8_neighbouring_regions(t):
    """Two blocks on either side of each block with a figure, united where they meet."""
    blocks = R.blocks(t.documents)
    extents = blocks.groupBy("doc_id").agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    return evidence.neighbourhoods(blocks.filter(F.col("text").rlike("[0-9]")), extents, ["doc_id"], "ordinal", 2)


@query("""WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey AS text FROM lineitem),
f AS (SELECT l_suppkey, greatest(1, (600 - length('Supplier ' || l_suppkey || chr(10) || 'order | line | part')) // (max(length(text)) + 1)) AS fits FROM r GROUP BY 1)
SELECT l_suppkey, CAST(i // fits AS BIGINT) AS "group", min(i) AS first_row, max(i) AS last_row, 'Supplier ' || l_suppkey || chr(10) || 'order | line | part' || chr(10) || string_agg(text, chr(10) ORDER BY i) AS text FROM r JOIN f USING (l_suppkey) GROUP BY l_suppkey, i // fits""")
def n9_row_groups(t):
    """Each supplier's lines as a table, in groups of up to 600 characters that repeat its header."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    rows = R.ranked(t.lineitem.select("l_suppkey", *order, F.concat_ws(" | ", "l_orderkey", "l_linenumber", "l_partkey").alias("text")), ["l_suppkey"], order, None, "n").select("l_suppkey", (F.col("n") - 1).cast("long").alias("i"), "text")
    header = t.lineitem.select("l_suppkey").distinct().withColumn("header", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"), F.lit("\norder | line | part")))
    return tables.row_groups(rows, header, ["l_suppkey"], "i", limit=600)


_MEASURED = f"""{Q._LISTS}, u AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1e0 / (rank + 60)), 12) DESC, min(rank), doc_id) AS rank FROM l GROUP BY 1, 2),
every AS (SELECT retriever, query_id, doc_id, rank FROM l UNION ALL SELECT 'fused', query_id, doc_id, rank FROM u),
judged AS (SELECT item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE regexp_matches(b.text, '[\\pL\\p{{Nd}}]')), wanted AS (SELECT query_id, count(*) AS relevant FROM judged GROUP BY 1),
hit AS (SELECT retriever, query_id, count(*) AS found, min(rank) AS first, sum(1e0 / log2(rank + 1e0)) AS gain FROM every JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1, 2)"""


@query(f"""WITH {_MEASURED} SELECT query_id, retriever, relevant, round(coalesce(found / relevant, 0e0), 6) AS recall, round(coalesce(1e0 / first, 0e0), 6) AS reciprocal_rank, round(coalesce(gain / list_sum([1e0 / log2(i + 1e0) FOR i IN range(1, least(relevant, 10) + 1)]), 0e0), 6) AS ndcg
FROM wanted CROSS JOIN (SELECT unnest(['bm25', 'sum', 'fused']) AS retriever) LEFT JOIN hit USING (query_id, retriever)""")
def n10_retrieval_metrics(t):
    """Recall, reciprocal rank and nDCG at ten of three lists, for passages of the benchmark that documents hold."""
    lists = Q._lists(t)
    fused = R.fuse(lists, "doc_id").select("query_id", "doc_id", F.lit("fused").alias("retriever"), F.col("place").alias("rank"))
    judged = metrics.planted(Q._queries(t), t.documents, "doc_id")
    every = lists.select("query_id", "doc_id", "retriever", "rank").unionByName(fused)
    made = metrics.measured(every, judged, "doc_id", 10, ["retriever"])
    return made.select("query_id", "retriever", "relevant", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))
