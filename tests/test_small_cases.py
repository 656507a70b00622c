"""Scans, embedding, layout, scopes, stages and the outbox on small cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightvein import seams
from brightvein.functions import lexemes
from brightvein.operators import embedding, lifecycle, reports, spatial, tables
from brightvein.operators import retrieval as R
from brightvein.sources import corpus, html, intake, scans, sinks
from brightvein.streaming import attempts, outbox


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def make_detector():
    def detector(content):  # not of the module, so that workers get the function itself
        if content.startswith(b"bad"):
            raise RuntimeError("unreadable")
        return json.loads(content)

    return detector


def test_scan_blocks(spark, tmp_path):
    box = lambda x, y: {"x0": float(x), "y0": float(y), "x1": x + 5.0, "y1": y + 5.0}
    (tmp_path / "a").write_text(json.dumps([{"page_number": 1, "kind": "block", "text": t, "box": box(x, y), "rotation": 0, "width": 100.0, "height": 200.0} for t, x, y in (("low", 0, 90), ("right", 50, 10), ("left", 0, 10))]))
    (tmp_path / "b").write_text("bad")
    got = scans.scan_blocks(spark, str(tmp_path), make_detector())
    assert [r["text"] for r in got.filter("failure_reason IS NULL").orderBy("ordinal").collect()] == ["left", "right", "low"]
    assert rows(got.filter("failure_reason IS NOT NULL"), "failure_reason") == [("RuntimeError",)]


def test_scan_tables(spark, tmp_path):
    cell = lambda r, c, t: {"table_id": "t", "page_number": 1, "r": r, "c": c, "text": t, "bbox": {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}}
    (tmp_path / "a").write_text(json.dumps([cell(0, 0, "h"), cell(0, 1, ""), cell(1, 1, "5")]))
    got = scans.scan_tables(spark, str(tmp_path), make_detector())
    assert rows(got.selectExpr("r", "c", "text", "bbox IS NULL AS absent"), "r", "c", "text", "absent") == [(0, 0, "h", False), (0, 1, "", False), (1, 0, None, True), (1, 1, "5", False)]


def test_locations(spark):
    page = '{"page_number": 1, "width": 10.0, "height": 5.0, "rotation": 90}'
    cases = [("page", page, True), ("page", page.replace("90", "45"), False), ("block", page, False), ("block", '{"bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 2}}', True), ("block", '{"bbox": {}, "more": 1}', False), ("cell", None, False)]
    df = spark.createDataFrame([(i, k, r) for i, (k, r, _) in enumerate(cases)], "i int, k string, raw string").withColumn("l", scans.decode_location(F.col("raw"), F.col("k")))
    assert [r["l"] is not None for r in df.orderBy("i").collect()] == [ok for *_, ok in cases]
    back = df.filter("i = 0").select(scans.encode_location(F.col("l")).alias("j")).first()["j"]
    assert json.loads(back) == json.loads(page)


def test_cell_elements_and_run_order(spark):
    df = spark.createDataFrame([("t", 3, 2, 0, 1, "5", ["H"]), ("t", 3, 2, 1, 1, None, ["H"])], "table_id string, page_number int, table_number int, r int, c int, text string, header_path array<string>").withColumns({"row_span": F.lit(1), "column_span": F.lit(None).cast("int")})
    got = scans.cell_elements(df).collect()
    assert len(got) == 1 and got[0]["locator"] == "p. 3, table 2, R1C2" and got[0]["location"]["column_span"] == 1
    tree = spark.createDataFrame([("r", "b", "p2", 0), ("r", "p2", None, 1), ("r", "p1", None, 0), ("r", "a", "p1", 1), ("x", "z", None, 0)], "run_id string, element_id string, parent_id string, ordinal int")
    assert [r["element_id"] for r in scans.run_elements(tree, "r").collect()] == ["p1", "p2", "a", "b"]


def test_embedding(spark):
    calls = seams.stand_in_embedder(8)
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "id long, text string")
    got = {r["id"]: r["vector"] for r in embedding.embed(df, calls, 8).collect()}
    assert got[1] == got[3] and got[4] is None and got[1] == pytest.approx(calls(["search_document: one"])[0])
    with pytest.raises(Exception, match="vectors of 9"):
        embedding.embed(df, calls, 9).collect()
    with pytest.raises(Exception, match="more than 6000"):
        embedding.embed(spark.createDataFrame([("x" * 6001,)], "text string"), calls, 8).collect()
    cache = spark.createDataFrame([], "digest string, text string, model string, config string, kind string, vector array<double>")
    out, new = embedding.embed_cached(df, cache, calls, 8, "m", "1")
    assert rows(new, "text") == [("one",), ("two",)] and out.filter("vector IS NOT NULL").count() == 3
    cache = spark.createDataFrame([(r["digest"], r["text"], "m", "1", "document", [9.0]) for r in new.collect()], cache.schema)
    out, new = embedding.embed_cached(df, cache, calls, 8, "m", "1")
    assert new.count() == 0 and {tuple(r["vector"]) for r in out.filter("text IS NOT NULL").collect()} == {(9.0,)} and out.count() == 4
    assert embedding.embed_cached(df, cache, calls, 8, "m", "2")[1].count() == 2


def test_lexemes(spark):
    got = spark.range(1).select(lexemes.parse_lexemes(F.lit("'net':1,5 'sale''s':2A 'tax'")).alias("l"), lexemes.term_index(F.lit("net")).alias("i"), lexemes.parse_lexemes(F.lit("")).alias("e")).first()
    assert [tuple(x) for x in got["l"]] == [("net", 2), ("sale's", 1), ("tax", 1)] and 0 <= got["i"] < 2**32 and got["e"] == []


def test_layout(spark):
    cells = spark.createDataFrame([(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "b", 20.0, 0.0, 30.0, 10.0)], "page int, cell string, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 2.0, 1.0, 4.0, 3.0), (1, 5.0, 1.0, 9.0, 3.0), (1, 50.0, 1.0, 52.0, 3.0)], "page int, sx0 double, sy0 double, sx1 double, sy1 double")
    assert rows(spatial.leftmost_text(spans, cells, ["page"], "cell"), "cell", "text_left") == [("a", 2.0)]
    bands = spark.createDataFrame([(1, 10.0, 20.0, 3), (1, 50.0, 60.0, 3), (1, 80.0, 90.0, 2)], "page int, top double, bottom double, members int")
    regions = spark.createDataFrame([("s", 1, 15.0, 30.0), ("u", 1, 31.0, 40.0), ("other page", 2, 1.0, 2.0)], "region string, page int, r0 double, r1 double")
    assert rows(spatial.unsupported(regions, bands, ["page"]), "region") == [("u",)]
    assert rows(spatial.missed_bands(bands, regions, ["page"]), "top") == [(50.0,)]
    tables = spark.createDataFrame([(1, "t", 100.0)], "page int, table_id string, top double")
    blocks = spark.createDataFrame([(1, "b1", "Debt (continued)", 50.0), (1, "b2", "Leases  (cont'd.) x", 90.0), (1, "b3", "Our growth continued", 95.0), (1, "b4", "Below (continued)", 120.0)], "page int, block_id string, text string, by0 double")
    assert rows(spatial.continuation(tables, blocks, ["page"]), "title") == [("Leases",)] and spatial.continuation(tables, blocks, ["page"], 1).count() == 0
    lines = spark.createDataFrame([(1, 0.0, 10.04, 50.0, 10.0), (1, 0.0, 5.0, 50.0, 5.0), (1, 0.0, 7.0, 9.0, 7.0), (1, 0.0, 7.0, 90.0, 17.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert spatial.rules(lines, ["page"]).first()["rules"] == [5.0, 10.0]
    grid = spark.createDataFrame([(0, 0, 0.0, 0.0, 5.0, 5.0), (1, 1, 6.0, 6.0, 9.0, 9.0)], "r int, c int, x0 double, y0 double, x1 double, y1 double").withColumn("t", F.lit(1))
    empty = spark.createDataFrame([(1, 0, 1), (1, 5, 1)], "t int, r int, c int")
    got = {r["r"]: r["bbox"] for r in spatial.empty_boxes(empty, grid, ["t"]).collect()}
    assert tuple(got[0]) == (6.0, 0.0, 9.0, 5.0) and got[5] is None
    pages = spark.createDataFrame([(1, 0, 0, 1, 0), (2, 0, 0, 0, 0), (3, 4, 0, 0, 90)], "p int, blocks int, tables int, images int, chars int")
    assert rows(spatial.page_signals(pages), "p", "gap", "text_bearing") == [(1, "image_only_page", False), (2, "no_content_extracted", False), (3, None, True)]
    a = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 20.0, 10.0))], f"a {scans.BOX}, b {scans.BOX}")
    assert a.select(spatial.box_share("a", "b").alias("s")).first()["s"] == 0.5


def test_scopes(spark):
    points = spark.createDataFrame([("g", "c1", 2024, [1, 2], "en"), ("g", "c2", 2023, [9], "en"), ("old", "c3", 2024, [1], "en"), ("g", "c4", None, None, "de")], "generation_id string, chunk_id string, fiscal_year int, page_numbers array<int>, lang string")
    active = spark.createDataFrame([("g",)], "generation_id string")
    found = lambda **f: [x[0] for x in rows(R.in_scope(points, active, f), "chunk_id")]
    assert found() == ["c1", "c2", "c4"] and found(fiscal_year=2024) == ["c1"] and found(fiscal_year=(None, 2023)) == ["c2"]
    assert found(pages=(2, 8)) == ["c1"] and found(lang=None, pages=9) == ["c2"] and found(lang=[]) == []
    assert R.filtered_count(points, active, {"lang": "en"}) == 2 and R.filtered_count(points, active.limit(0), {}) == 0
    assert R.year_bounds(2020) == (2020, 2020) and R.year_bounds(None) is None
    reports.guard_apart(active, points.filter("generation_id = 'old'"), "generation_id")
    with pytest.raises(ValueError):
        reports.guard_apart(active, points, "generation_id")


def test_nearest_before(spark):
    made = [(u, i, "ab"[i % 3 % 2], f"2024-01-0{1 + i // 8} {3 * (i % 8):02d}:00:00") for u in (1, 2) for i in range(16)]
    df = spark.createDataFrame(made, "u int, i int, k string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("id", F.col("u") * 100 + F.col("i"))
    got = dict(rows(reports.nearest_before(df, "u", "ts", "id", "k", 6, "before"), "id", "before"))
    want = {}
    for u, i, k, _ in made:
        earlier = [j for v, j, m, _ in made if v == u and j < i and m != k and 3 * (i - j) <= 6]
        if earlier:
            want[u * 100 + i] = u * 100 + max(earlier)
    assert got == want


def test_cache_rechecks_text(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, text string")
    b = spark.createDataFrame([(7, "x")], "item long, text string")
    assert rows(reports.cache_hits(a, b), "id", "item") == [(1, 7)]
    assert rows(reports.cache_misses(a.select("text"), b.select("text")), "text") == [("y",), (None,)]


def test_stages(spark):
    selected = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "doc string, n int")
    done = spark.createDataFrame([("c", "v1", None), ("a", "v1", "OSError"), ("a", "v0", None)], "doc string, config string, failure string")

    def work(row):
        1 / row["n"]

    out = lifecycle.run_stage(selected, selected, done, "doc", "v1", work).cache()
    assert rows(out, "doc", "failure") == [("a", None), ("b", "ZeroDivisionError")]
    assert tuple(lifecycle.stage_report(out).first())[:2] == (2, 1)
    with pytest.raises(ValueError, match="not ready"):
        lifecycle.run_stage(selected, selected.filter("doc <> 'a'"), done, "doc", "v1", work)


def test_outbox_failures(spark, tmp_path):
    """A permanent failure is laid aside with its reason, a transient one resumes, and redelivery changes nothing."""
    schema = "chunk_id long, text string"
    put = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/out")
    put([1, 2])
    at = [str(tmp_path / x) for x in ("out", "index", "dead", "check")]
    down = [True]

    def transform(df):
        if df.schema and down[0] and df.limit(1).count():
            raise ConnectionError("away")
        if df.filter("chunk_id = 9").limit(1).count():
            raise ValueError("bad text")
        return df

    with pytest.raises(Exception, match="away"):
        outbox.drain(spark, *at, schema, transform)
    assert spark.read.parquet(at[1]).count() == 0
    down[0] = False
    outbox.drain(spark, *at, schema, transform)
    put([2, 3])
    put([9])
    outbox.drain(spark, *at, schema, transform)
    rows_, index, dead = (spark.read.parquet(x) for x in at[:3])
    assert rows(index, "chunk_id") == [(1,), (2,), (3,)] and rows(dead, "chunk_id", "failure_reason") == [(9, "ValueError")]
    put([4])
    rows_ = spark.read.parquet(at[0])
    assert rows(outbox.states(rows_, index, dead), "chunk_id", "state", "attempts") == [(1, "completed", 1), (2, "completed", 1), (3, "completed", 1), (4, "pending", 0), (9, "failed", 1)]
    assert [r[0] for r in outbox.pending(rows_, index, dead, ["text"], 5).collect()] == [4]


def test_rows_that_fail_alone(spark, tmp_path):
    """An over-long text is laid aside with its reason while the rest of its batch goes on; a redelivered batch tells it once."""
    put = lambda made: spark.createDataFrame(made, "chunk_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/out")
    put([(1, "one"), (2, "x" * 7000), (3, "three"), (4, None)])
    at = [str(tmp_path / x) for x in ("out", "index", "dead", "check")]
    transform = lambda df: embedding.embed(df, seams.stand_in_embedder(8), 8, tell=True)
    outbox.drain(spark, *at, "chunk_id long, text string", transform)
    outbox.drain(spark, *at[:3], str(tmp_path / "again"), "chunk_id long, text string", transform)
    assert rows(spark.read.parquet(at[1]), "chunk_id") == [(1,), (3,), (4,)]
    assert rows(spark.read.parquet(at[2]), "chunk_id", "failure_reason") == [(2, "TextTooLong")]
    wrong = embedding.embed(spark.createDataFrame([(1, "a")], "chunk_id long, text string"), lambda ts: [[1.0]] * len(ts), 8, tell=True)
    assert rows(wrong, "vector", "failure") == [(None, "WrongShape")]


def test_attempts_survive_a_restart(spark, tmp_path):
    """Attempts and back-off go on from the checkpoint; five failures end an event, success and redelivery change nothing more."""
    start = dt.datetime(2024, 1, 1)
    put = lambda made: spark.createDataFrame([(i, ok, start + dt.timedelta(seconds=s)) for i, ok, s in made], "chunk_id long, ok boolean, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/told")
    run = lambda: attempts.run(spark, f"{tmp_path}/told", f"{tmp_path}/changes", f"{tmp_path}/check")
    state = lambda: rows(attempts.now(spark.read.parquet(f"{tmp_path}/changes")), "chunk_id", "attempts", "state")
    put([(1, False, 0), (2, True, 0), (3, False, 0)])
    run()
    assert state() == [(1, 1, "pending"), (2, 1, "completed"), (3, 1, "pending")]
    put([(1, False, 10), (3, True, 30), (2, False, 40)])  # event 1 was not due before 30
    run()
    assert state() == [(1, 1, "pending"), (2, 1, "completed"), (3, 2, "completed")]
    events = spark.createDataFrame([(1,), (2,), (9,)], "chunk_id long")
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert rows(attempts.due(events, changes, start + dt.timedelta(seconds=20)), "chunk_id") == [(9,)]
    assert rows(attempts.due(events, changes, start + dt.timedelta(seconds=30)), "chunk_id") == [(1,), (9,)]
    put([(1, False, 30 * (2 ** (i + 1) - 1)) for i in range(4)])
    run()
    assert state()[0] == (1, 5, "failed")


def test_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("entry_id", T.StringType()), T.StructField("split", T.StringType()), T.StructField("byte_size", T.LongType())])
    (tmp_path / "m.toml").write_text('version = 1\n[[entries]]\nentry_id = "a"\nsplit = " Development "\nbyte_size = 3\n')
    load = lambda **o: corpus.load_manifest(spark, str(tmp_path / "m.toml"), schema, **o)
    assert rows(load(choices={"split": ("development", "held_out")}), "entry_id", "split", "byte_size") == [("a", "development", 3)]
    for bad in ({"version": 2}, {"choices": {"split": ("held_out",)}}):
        with pytest.raises(ValueError):
            load(**bad)
    (tmp_path / "m.toml").write_text('version = 1\n[[entries]]\nentry_id = "a"\nextra = 1\n')
    with pytest.raises(ValueError, match="entry 0"):
        load()


def test_sinks_add_once(spark, tmp_path):
    elements = spark.createDataFrame([("r", f"e{i}", None, i, 0, "page", "t", None, 1) for i in range(3)], "run_id string, element_id string, parent_id string, ordinal int, depth int, element_type string, text string, failure_reason string, page_number int")
    answers = spark.createDataFrame([(1, "answered", 1)], "answer_id long, decision string, released int")
    claims = spark.createDataFrame([(1, 0, "c"), (1, 1, "d")], "answer_id long, claim_index int, text string")
    chunks = spark.createDataFrame([(1, 0, "parent", "p", None, ["e1"]), (1, 1, "child", "c", 0, ["e1", "e2", "e1"])], "doc_id long, ordinal int, role string, text string, parent int, element_ids array<string>")
    for _ in range(2):
        sinks.record_elements(elements, f"{tmp_path}/e")
        sinks.record_answers(answers, claims, f"{tmp_path}/a")
        sinks.record_chunks(chunks, f"{tmp_path}/c", "g", "v", "1")
    count = lambda p: spark.read.parquet(f"{tmp_path}/{p}").count()
    assert [count(p) for p in ("e/elements", "a/answers", "a/answer_claims", "c/chunks", "c/chunk_sources", "c/outbox")] == [3, 1, 2, 2, 3, 1]


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.txt").write_bytes(b"x" * 5000)
    (tmp_path / "in" / "ok.txt").write_bytes(b"fine")
    (tmp_path / "in" / "none.txt").write_bytes(b"")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # the reader refuses to read more
    got = {r["original_filename"]: (r["byte_size"], r["rejected"]) for r in intake.received(spark, str(tmp_path / "in"), most=1000).collect()}
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {"big.txt": (5000, "too_large"), "ok.txt": (4, None), "none.txt": (0, "empty")}


def brute_places(rows, sections):
    """Places of declared cells by a whole map of what is taken."""
    taken, out = {}, []
    for r, row in enumerate(rows):
        end = min(e for e in [*sections, len(rows)] if e > r)
        c = 0
        for text, down, across, header in row:
            while (r, c) in taken:
                c += 1
            down = end - r if down == 0 else min(down, end - r)
            wide = 1
            while wide < across and (r, c + wide) not in taken:
                wide += 1
            for y in range(r, r + down):
                for x in range(c, c + wide):
                    taken[y, x] = text
            out.append((r, c, text, down, wide, header))
            c += wide
    return out


def test_declared_spans():
    r = random.Random(5)
    for _ in range(300):
        rows = [[(f"{y}.{x}", r.choice([0, 1, 1, 2, 3]), r.choice([1, 1, 2, 3]), False) for x in range(r.randint(0, 5))] for y in range(r.randint(1, 7))]
        sections = sorted({r.randint(1, len(rows)) for _ in range(r.randint(0, 2))})
        assert html.placed(rows, sections) == brute_places(rows, sections)


def test_html_pages(spark, tmp_path):
    page = """<html><head><title>T &amp; U</title><style>p{}</style></head><body><h2>One<br>two</h2><p>First<p>second <b>bold</b><script>var t="<p>no"</script>
    <ul><li>a<li>b</ul><table><caption>Cap</caption><thead><tr><th rowspan=2>Item<th colspan="2">Year<tr><th>2024<th>2023</thead><tbody><tr><td>Rent<td><td>4<tr><td rowspan="0">Tax<td colspan=x>1</tbody></table>end<table><tr><td>in<table><tr><td>deep</table>out</table>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain")], "id long, html string")
    got = html.html_blocks(pages, "id").orderBy("id", "ordinal").collect()
    assert [(x["kind"], x["text"]) for x in got if x["id"] == 1 and x["kind"] != "cell"] == [("title", "T & U"), ("heading", "One two"), ("paragraph", "First"), ("paragraph", "second bold"), ("item", "a"), ("item", "b"), ("paragraph", "Cap"), ("text", "end")]
    assert [x["text"] for x in got if x["id"] in (2, 3)] == [] and [x["text"] for x in got if x["id"] == 4] == ["plain"]
    cells = {(x["r"], x["c"]): (x["text"], x["present"]) for x in html.grids(html.html_blocks(pages, "id"), ["id"]).collect() if x["table_id"] == "1/0"}
    assert cells == {(0, 0): ("Item", True), (0, 1): ("Year", True), (0, 2): ("", False), (1, 0): ("", False), (1, 1): ("2024", True), (1, 2): ("2023", True), (2, 0): ("Rent", True), (2, 1): ("", True), (2, 2): ("4", True), (3, 0): ("Tax", True), (3, 1): ("1", True), (3, 2): ("", False)}
    derived = tables.derive(html.grids(html.html_blocks(pages, "id"), ["id"]).filter("table_id = '1/0'"))
    assert derived.count() == 12 and {x["text"] for x in derived.filter("is_header").collect()} >= {"Year", "2024", "2023"}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.html").write_text(page)
    (tmp_path / "b.txt").write_text("no")
    html.register(spark)
    read = spark.read.format("html_pages").load(str(tmp_path))
    assert read.count() == sum(x["id"] == 1 for x in got) and read.filter("kind = 'heading'").first()["path"].endswith("deep/a.html")


def test_store_and_cache(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    (tmp_path / "store" / "a").mkdir(parents=True)
    (tmp_path / "store" / "a" / "x").write_bytes(b"abc" * 1000)
    (tmp_path / "store" / "empty").write_bytes(b"")
    keys = spark.createDataFrame([("a/x",), ("a/y",)], "object_key string")
    assert rows(intake.stored_objects(spark, at, keys), "object_key", "exists", "byte_size") == [("a/x", True, 3000), ("a/y", False, None)]
    parts = intake.opened(at, spark.createDataFrame([("a/x",), ("empty",)], "object_key string"), 1024).orderBy("object_key", "at").collect()
    assert b"".join(p["data"] for p in parts if p["object_key"] == "a/x") == b"abc" * 1000 and [p["at"] for p in parts] == [0, 1024, 2048, 0]
    cache = spark.createDataFrame([("d1", 5), ("d2", 1), ("d3", 9)], "digest string, used_at int")
    now = sinks.touched(cache, spark.createDataFrame([("d2", 7), ("d2", 6), ("d3", 2), ("d9", 9)], "digest string, used_at int"), ["digest"])
    assert rows(now, "digest", "used_at") == [("d1", 5), ("d2", 7), ("d3", 9)]
    now.write.parquet(f"{tmp_path}/cache")
    assert sinks.prune_cache(spark, f"{tmp_path}/cache", 7) == 1 and sinks.prune_cache(spark, f"{tmp_path}/cache", 7) == 0
    assert rows(spark.read.parquet(f"{tmp_path}/cache"), "digest") == [("d2",), ("d3",)]
