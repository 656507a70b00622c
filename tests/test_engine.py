"""The engine's queries against their SQL, and its operators on small cases."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brightvein.functions import analysis
from brightvein.functions import text as X
from brightvein.operators import lifecycle
from brightvein.operators import retrieval as R
from brightvein.plans import registry
from brightvein.streaming import outbox

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in got.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0


@pytest.mark.parametrize("text,level", [("1. Brief outline", 1), ("3.2 Property held", 2), ("7.2.1 Deferred tax", 3), ("Item 7", 1), ("Part II", 1), ("3 Somebody", None), ("7.6 years", None), ("It ended. Then 3.", None)])
def test_heading_levels(spark, text, level):
    assert spark.range(1).select(X.heading_level(F.lit(text)).alias("l")).first()["l"] == level


@pytest.mark.parametrize("text,values", [("1,00,00,000", [10000000]), ("a loss of (45)", [-45]), ("−3.5 and –2", [-3.5, -2]), ("none", []), ("2023-24", [2023, -24])])
def test_numerals(spark, text, values):
    got = spark.range(1).select(X.numerals(F.lit(text)).alias("n")).first()["n"]
    assert [float(x) for x in got] == values


def test_digit_groups(spark):
    got = spark.range(1).select(*(analysis.join_digit_groups(F.lit(t)) for t in ("(10,000)", "1,2345", "notes 1,2,3"))).first()
    assert list(got) == ["(10000)", "1,2345", "notes 1,2,3"]


def test_glyphs_twice_as_once(spark):
    once = X.normalise_glyphs(F.lit("ofﬁce x‐\ny z​"))
    got = spark.range(1).select(once.alias("a"), X.normalise_glyphs(once).alias("b")).first()
    assert got["a"] == got["b"] == "office x-y z"


def test_budget_skips_and_goes_on(spark):
    items = spark.sql("SELECT array(named_struct('i', 1, 'chars', 400L), named_struct('i', 2, 'chars', 700L), named_struct('i', 3, 'chars', 100L)) AS items")
    assert [x["i"] for x in items.select(R.within_budget(F.col("items"), 600).alias("k")).first()["k"]] == [1, 3]


def test_dedupe_not_transitive(spark):
    items = spark.sql("SELECT array(named_struct('i', 1, 'elements', array('a')), named_struct('i', 2, 'elements', array('a', 'b')), named_struct('i', 3, 'elements', array('b')), named_struct('i', 4, 'elements', CAST(array() AS array<string>))) AS items")
    assert [x["i"] for x in items.select(R.greedy_dedupe(F.col("items")).alias("k")).first()["k"]] == [1, 3, 4]


def test_whole_texts_tell_blocks_apart(spark, tmp_path):
    """Blocks that begin alike are separate evidence and separate titles; equal ones are the same evidence."""
    same = "alike at the very beginning, then"
    rows = [(1, f"{same} one", "en", "s"), (2, f"{same} another", "en", "s"), (3, f"{same} one", "de", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, f"{same} one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.QUERIES["g12_evidence_dedupe"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in got) == [(7, 1), (7, 2)]
    paths = registry.QUERIES["e4_heading_paths"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["path"] for r in paths} == {i: [t] for i, t, _, _ in rows}


def test_filtered_search_reaches_every_document(spark, duck):
    """Documents outside the ids 100 to 600 are found too, and more than three values of a key are kept."""
    got = {r["doc_id"] for r in registry.QUERIES["b1_filtered_search_whole"](spark, FOLDER).collect()}
    assert min(got) < 100
    per = registry.QUERIES["d4_sections_by_version_ten"](spark, FOLDER).groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert per == min(10, duck.sql("SELECT max(k) FROM (SELECT count(DISTINCT event_type) AS k FROM events WHERE event_type <> '' GROUP BY user_id)").fetchall()[0][0])


def test_fusion_scores(spark):
    lists = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "x", 2), (1, "a", "y", 2)], "query_id long, retriever string, id string, rank int")
    got = {r["id"]: r["score"] for r in R.fuse(lists, "id").collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["y"] == pytest.approx(1 / 62)


def test_empty_list_filters_everything(spark):
    df = spark.range(5)
    assert R.hard_filter(df, id=[]).count() == 0
    assert R.hard_filter(df, id=(1, None)).count() == 4
    with pytest.raises(ValueError):
        R.hard_filter(df, id=(3, 1))


def test_edge_order(spark):
    assert [r[0] for r in spark.range(1, 6).orderBy(R.edge_order(F.col("id"))).collect()] == [1, 3, 5, 4, 2]


def test_upsert(spark):
    now, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, lifecycle.upsert(now, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_outbox_drains_once(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "index", "dead", "state")}
    spark.createDataFrame([(i % 7, "t") for i in range(10)], "chunk_id long, text string").repartition(2).write.parquet(at["in"])
    schema = spark.read.parquet(at["in"]).schema
    for _ in range(2):
        outbox.drain(spark, at["in"], at["index"], at["dead"], at["state"], schema, lambda df: df)
    assert spark.read.parquet(at["index"]).count() == 7
