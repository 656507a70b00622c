"""Joins, aggregates, rankings and state over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lifecycle, reports, sections, spatial
from ._tables import registrar

QUERIES: dict = {}
SQL: dict = {}
query = registrar(QUERIES, SQL)


@query("SELECT c_custkey, o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def c1_scoped_join(t):
    return reports.scoped(t.orders, t.customer, "o_custkey", "c_custkey", t.nation, ("c_nationkey", "n_nationkey"), F.col("o_orderstatus") == "F").select("c_custkey", "o_orderkey", "n_name")


@query("SELECT a.event_id AS child, b.event_id AS parent FROM events a JOIN events b ON a.event_id = b.event_id * 2 WHERE a.event_type = b.event_type")
def c2_parent_self_join(t):
    half = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") / 2).cast("long"))
    return reports.parents(t.events.select("event_id", "event_type"), "event_id", half, F.expr("child.event_type = parent.event_type"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def c3_load_context(t):
    return reports.load_context(t.documents.select("doc_id", "lang"), t.labels.filter("toxic = 0"), t.labels.select("doc_id", "quality"), "doc_id")


@query("SELECT o_orderkey, o_orderdate, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 64")
def c4_pending_batch(t):
    own = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return reports.pending_batch(own, "o_orderstatus", "P", ["o_orderdate", "o_orderkey"], 64).select("o_orderkey", "o_orderdate", "c_mktsegment")


@query("SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS cited FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def c5_citations_in_order(t):
    got = t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return reports.listed_in_order(got, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", "cited")


@query("SELECT p_partkey, coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), []) AS regions FROM part LEFT JOIN (SELECT DISTINCT l_partkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000) ON p_partkey = l_partkey GROUP BY p_partkey")
def c6_blocks_with_regions(t):
    rich = t.lineitem.join(t.supplier.filter("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_suppkey").distinct()
    return reports.with_list(t.part, rich, "p_partkey", "l_partkey", "s_suppkey", "regions")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def c8_active_semi_join(t):
    return reports.within(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey")


_BOXES = "SELECT event_id, user_id % 50 AS page, event_id % 97 AS y0, event_id % 97 + 10 + event_id % 7 AS y1 FROM events"


@query(f"WITH b AS ({_BOXES}), r AS (SELECT s_suppkey AS region, s_suppkey % 50 AS page, s_suppkey * 13 % 90 AS r0, s_suppkey * 13 % 90 + 20 AS r1 FROM supplier), o AS (SELECT event_id, region, (least(y1, r1) - greatest(y0, r0)) / (y1 - y0) AS share, r1 - r0 AS area FROM b JOIN r USING (page) WHERE least(y1, r1) > greatest(y0, r0)) SELECT event_id, region FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY share DESC, area, region) AS n FROM o WHERE share > 0.5) WHERE n = 1")
def c9_containing_region(t):
    b = t.events.selectExpr("event_id", "user_id % 50 AS page", "event_id % 97 AS y0", "event_id % 97 + 10 + event_id % 7 AS y1")
    r = t.supplier.selectExpr("s_suppkey AS region", "s_suppkey % 50 AS page", "s_suppkey * 13 % 90 AS r0", "s_suppkey * 13 % 90 + 20 AS r1")
    return spatial.best_region(b, r, ["page"], "event_id", "region", spatial.overlap_share(("y0", "y1"), ("r0", "r1")), F.expr("r1 - r0"))


@query(f"WITH b AS ({_BOXES}), r AS (SELECT s_suppkey AS region, s_suppkey % 50 AS page, s_suppkey * 13 % 90 AS r0, s_suppkey * 13 % 90 + 2 AS r1 FROM supplier) SELECT region FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = r.page AND NOT (b.y1 < r.r0 OR b.y0 > r.r1))")
def c12_unsupported_regions(t):
    b = t.events.selectExpr("user_id % 50 AS page", "event_id % 97 AS top", "event_id % 97 + 10 + event_id % 7 AS bottom").distinct()
    r = t.supplier.selectExpr("s_suppkey AS region", "s_suppkey % 50 AS page", "s_suppkey * 13 % 90 AS r0", "s_suppkey * 13 % 90 + 2 AS r1")
    bare = r.join(b.select("page").distinct(), "page", "left_anti")
    return spatial.unsupported(r, b, ["page"]).unionByName(bare).select("region")


@query("SELECT a.event_id, max_by(b.event_id, b.ts) AS before_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 6 HOUR GROUP BY a.event_id")
def c14_nearest_before(t):
    return reports.nearest_before(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type", 6, "before_id")


@query("SELECT DISTINCT sha256(d.text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE sha256(b.text) = sha256(d.text) AND b.text = d.text)")
def c16_cache_misses(t):
    return reports.cache_misses(t.documents.select("text"), t.benchmark.select("text")).select("digest")


@query("SELECT count(*) AS events, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value IS NULL) AS gaps, count(DISTINCT user_id) AS users FROM events")
def d1_conditional_counts(t):
    own = t.events
    out = reports.counts(own, None, clicks=F.col("event_type") == "click", gaps=F.col("value").isNull()).withColumnRenamed("total", "events")
    return out.withColumn("users", own.agg(F.countDistinct("user_id")).scalar())


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(lines, 0) AS lines, median_price FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(round_even(quantile_cont(o_totalprice, 0.5), 0) AS BIGINT) AS median_price FROM orders GROUP BY 1) o ON c_custkey = o.o_custkey LEFT JOIN (SELECT o_custkey, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) l ON c_custkey = l.o_custkey")
def d2_library_listing(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), reports.half_even_median("o_totalprice").alias("median_price"))
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"))
    lines = t.orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("k").alias("lines"))
    both = reports.listing(t.customer.select("c_custkey"), "c_custkey", o, lines)
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"), "median_price")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type <> '' GROUP BY 1, 2) WHERE r <= 3")
def d4_sections_by_version(t):
    return reports.most_frequent(t.events, ["user_id"], "event_type", 3).drop("rank")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE event_type <> '' GROUP BY 1, 2) WHERE r <= 10")
def d4_sections_by_version_ten(t):
    """As d4_sections_by_version, with the ten most frequent values of each key."""
    return reports.most_frequent(t.events, ["user_id"], "event_type", 10).drop("rank")


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 200")
def d5_distinct_sections(t):
    return reports.distinct_sorted(t.part, "p_type", 200)


@query("SELECT list_sort(list(DISTINCT lang) FILTER (lang <> '')) AS langs, list_sort(list(DISTINCT source) FILTER (source <> '')) AS sources FROM documents")
def d6_facets(t):
    return reports.facets(t.documents, ["lang", "source"])


@query("SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def d7_index_state(t):
    return reports.counts(t.orders, ["o_orderstatus"]).select(F.col("o_orderstatus").alias("state"), F.col("total").alias("n"))


@query("SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def d8_activity(t):
    return reports.activity(t.events, "event_type", "value", {"median": 0.5, "p95": 0.95})


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS reason FROM part) GROUP BY 1")
def d9_reason_frequency(t):
    return reports.element_frequency(t.part, F.split("p_type", " "), "reason")


@query("SELECT count(*) AS entries, min(ts) AS first_used, max(ts) AS last_used, count(*) FILTER (ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS unused, count(DISTINCT event_type) AS kinds FROM events")
def d10_cache_statistics(t):
    return reports.cache_statistics(t.events, "ts", "event_type", 7)


@query("SELECT l_orderkey, CASE WHEN share > 0.7 THEN 'accepted' WHEN share > 0.3 THEN 'doubtful' ELSE 'rejected' END AS verdict FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') / count(*) AS share FROM lineitem GROUP BY 1)")
def d14_quality_verdict(t):
    share = t.lineitem.groupBy("l_orderkey").agg((F.count_if(F.col("l_returnflag") == "N") / F.count("*")).alias("share"))
    return share.select("l_orderkey", F.when(F.col("share") > 0.7, "accepted").when(F.col("share") > 0.3, "doubtful").otherwise("rejected").alias("verdict"))


@query("SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def d15_grid_bounds(t):
    return spatial.grid_bounds(t.lineitem, [], "l_suppkey", "l_quantity", "l_quantity")


@query("SELECT text, count(DISTINCT source) AS splits FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def d16_split_violations(t):
    return reports.split_violations(t.documents.select("text", "source"), "text", "source")


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'failed' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'succeeded' END AS state FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def d17_run_state(t):
    return reports.run_states(t.customer, t.orders, "c_custkey", "o_custkey", F.col("o_orderstatus") == "P")


@query("SELECT coalesce(NOT bool_or(o_orderstatus = 'X'), true) AS ready FROM orders")
def d18_readiness(t):
    return reports.ready(t.orders, F.col("o_orderstatus") == "X")


@query("SELECT user_id, CASE WHEN a = 0 THEN 'abstained' WHEN b = 0 THEN 'answered' ELSE 'partial' END AS decision FROM (SELECT user_id, count(*) FILTER (value > 50) AS a, count(*) FILTER (value <= 50) AS b FROM events GROUP BY 1)")
def d19_decisions(t):
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("a"), F.count_if(F.col("value") <= 50).alias("b"))
    return n.select("user_id", F.when(F.col("a") == 0, "abstained").when(F.col("b") == 0, "answered").otherwise("partial").alias("decision"))


@query("SELECT event_type, count(*) FILTER (value > 10) / nullif(count(*), 0) AS hit_rate, sum(value) AS total FROM events GROUP BY 1")
def d23_hit_rate(t):
    return reports.rate(t.events, ["event_type"], F.col("value") > 10, total="value")


@query("SELECT user_id, max_by(event_id, ts) AS latest FROM events GROUP BY 1 HAVING count(*) FILTER (ts = (SELECT max(ts) FROM events)) >= 0")
def e19_latest_per_key(t):
    return reports.latest_value(t.events, ["user_id"], "event_id", ["ts"])


@query("WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, sum(c::int) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM s")
def e6_runs(t):
    return sections.runs_of(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "run")


@query("WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS INT) % 2 AS level FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, level ORDER BY event_id) AS g FROM s) SELECT user_id, event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, level, g) <= 2 THEN level END AS level FROM r")
def e3_suppressed_runs(t):
    own = t.events.selectExpr("user_id", "event_id", "CAST(floor(value) AS INT) % 2 AS level")
    return sections.suppress_list_runs(own, ["user_id"], "event_id")


@query("WITH v AS (SELECT DISTINCT l_suppkey, l_quantity AS q FROM lineitem WHERE l_quantity % 3 <> 0), c AS (SELECT *, coalesce(q - lag(q) OVER (PARTITION BY l_suppkey ORDER BY q) > 1, true) AS c FROM v), b AS (SELECT *, sum(c::int) OVER (PARTITION BY l_suppkey ORDER BY q) AS band FROM c) SELECT l_suppkey, band, min(q) AS top, max(q) AS bottom, count(*) AS members FROM b GROUP BY 1, 2")
def e9_bands(t):
    return sections.bands(t.lineitem.filter("l_quantity % 3 <> 0"), ["l_suppkey"], "l_quantity", 1.0)


@query("WITH d AS (SELECT DISTINCT o_custkey, o_orderkey % 1000 AS page FROM orders), g AS (SELECT *, page - row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS k FROM d) SELECT o_custkey, min(page) AS first, max(page) AS last FROM g GROUP BY o_custkey, k")
def e16_contiguous(t):
    return sections.contiguous(t.orders.selectExpr("o_custkey", "o_orderkey % 1000 AS page"), ["o_custkey"], "page")


@query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - l_linenumber AS span FROM lineitem")
def e10_spans(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.lead("l_linenumber").over(w) - F.col("l_linenumber")).alias("span"))


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC")
def f9_newest_first(t):
    return t.events.filter("event_type = 'click'").select("event_id").orderBy(F.desc("event_id"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def a22_latest_wins(t):
    return lifecycle.latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def a23_insert_missing(t):
    return lifecycle.insert_missing(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), t.events.select("user_id"), ["user_id"])


@query("SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' ELSE 'superseded' END AS state FROM orders")
def j2_activation(t):
    return lifecycle.one_active(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "state")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def j8_prunable(t):
    return reports.outside(t.orders, t.lineitem.filter("l_quantity > 40"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("SELECT l_orderkey, count(*) AS placed FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def s5_duplicate_placements(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("placed")).filter("placed > 1")
