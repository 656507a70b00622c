"""The path from files to answers: intake, chunking, search with its fallbacks, asking, generations, sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brightvein import seams
from brightvein.functions import analysis
from brightvein.functions import text as X
from brightvein.operators import answering, chunking, evidence, fulltext, generations, hybrid, sections
from brightvein.operators import retrieval as R
from brightvein.sources import intake, sinks


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("text", "level"),
    [("4. Borrowings and leases", 1), ("4.1 Secured loans", 2), ("4.1.2 Terms", 3), ("4.1.2.9 Covenants", 4), ("4 Borrowings", None), ("8.4 years", None), ("5. We repaid it all.", None), ("5. No", None), ("Item 12", 1), ("ITEM 9 Controls.", 1), ("Item 7A", None), ("Notes 4", 1), ("Appendix II", 1), ("Schedule L", 1), ("Note 12.", 1), ("6.\n  Related\n parties", 1), ("Part of it", None), ("", None), ("1. " + "Long " * 40, None), ("3. Été des comptes", 1)],
)
def test_heading_levels(spark, text, level):
    assert spark.range(1).select(X.heading_level(F.lit(text)).alias("l")).first()["l"] == level


def test_figures(spark):
    cases = {"(45) and ( 46 ) and (47": ["-45", "46", "47"], "−1,00,000.50 –7 -0.0": ["-100000.5", "-7", "0"], "0012 123456789012345678901234567890.12345678901234": ["12", "123456789012345678901234567890.12345678901234"], "none": []}
    for text, want in cases.items():
        assert spark.range(1).select(X.figures(F.lit(text)).alias("f")).first()["f"] == want
    got = spark.range(1).select(X.unsupported(F.lit("(5) 6 6.0 7"), F.lit("-5 and 7.00")).alias("u")).first()["u"]
    assert got == ["6"]


def test_glyphs_and_analysis(spark):
    one = lambda t: spark.range(1).select(X.normalise_glyphs(F.lit(t)).alias("a"), X.normalise_glyphs(X.normalise_glyphs(F.lit(t))).alias("b")).first()
    for text, want in {"a-\nb-\nc": "a-b-c", "é- \n  ü": "é-ü", "2023-\n24": "2023-\n24", "x‐\ny": "x-y"}.items():
        assert tuple(one(text)) == (want, want)
    assert spark.range(1).select(analysis.analysed(F.lit("Long-term 1,23,456")).alias("t")).first()["t"] == ["long", "term", "123456", "longterm"]


def test_markers(spark):
    for text, body, mark in (("Rent (a)", "Rent", "a"), ("Rent *", "Rent", "*"), ("Rent (EPS)", "Rent (EPS)", None), ("(a)", "(a)", None), ("Tax (iv)", "Tax", "iv"), ("Tax(12)", "Tax", "12"), ("†", "†", None)):
        got = spark.range(1).select(X.without_marker(F.lit(text)).alias("b"), X.footnote_marker(F.lit(text)).alias("m"), X.marker_key(F.lit(f" ({mark}) ")).alias("k")).first()
        assert (got["b"], got["m"]) == (body, mark) and (mark is None or got["k"] == mark.lower())
    assert spark.range(1).select(X.looks_numeric(F.lit("Rs 1,200 (net)")).alias("a"), X.looks_numeric(F.lit("Rs. (1,200)%")).alias("b"), X.looks_numeric(F.lit("₹")).alias("c")).first()[0:3] == (False, True, False)


def test_heading_paths_of_blocks(spark):
    made = [(1, 0, "intro", None), (1, 1, "A", 1), (1, 2, "x", None), (1, 3, "B", 2), (1, 4, "y", None), (1, 5, "C", 1), (2, 0, "z", None)]
    out = sections.with_heading_paths(spark.createDataFrame(made, "d long, o int, text string, level int"), ["d"], "o")
    assert {(r["d"], r["o"]): r["heading_path"] for r in out.collect()} == {(1, 0): [], (1, 1): ["A"], (1, 2): ["A"], (1, 3): ["A", "B"], (1, 4): ["A", "B"], (1, 5): ["C"], (2, 0): []}


def slow_split(text, most, count):
    """Oversize splitting by trying every prefix, longest first."""
    if count(text) <= most:
        return [text]
    out = []
    for kind in ("sentence", "word", "char"):
        spans = chunking.sentence_spans(text) if kind == "sentence" else [m.span() for m in __import__("re").finditer(r"\S+", text)] if kind == "word" else [(i, i + 1) for i in range(len(text))]
        if len(spans) > 1:
            break
    while spans:
        n = max((n for n in range(1, len(spans) + 1) if count(text[spans[0][0] : spans[n - 1][1]]) <= most), default=1)
        # greedy filling stops at the first that doesn't fit
        first = next((m for m in range(1, len(spans)) if count(text[spans[0][0] : spans[m][1]]) > most), len(spans))
        n = min(n, first) if first else n
        out += slow_split(text[spans[0][0] : spans[n - 1][1]], most, count) if kind != "char" else [text[spans[0][0] : spans[n - 1][1]]]
        spans = spans[n:]
    return out


def test_split_oversize():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["Net sales rose. ", "A b ", "w" * r.randint(1, 60) + " ", "loss of 5. (Then) ", "  "]) for _ in range(r.randint(1, 12))).strip() or "x"
        most = r.randint(3, 12)
        got = chunking.split_oversize(text, most)
        assert got == slow_split(text, most, seams.estimated_tokens)
        assert "".join("".join(got).split()) == "".join(text.split())
    assert chunking.split_oversize("     " * 20, 2) == ["     " * 20]


def slow_chunks(blocks, budget, count):
    """Children and parents of one run of blocks, as the rules read."""
    windows, now, used = [], [], 0
    for b in blocks:
        if now and used + count(b) > budget.parent:
            windows.append(now)
            now, used = [], 0
        now.append(b)
        used += count(b)
    windows.append(now)
    out = []
    for w in windows:
        kids, open_ = [], None
        for b in w:
            if count(b) > budget.child:
                open_ = None
                kids += [(p, p != b) for p in slow_split(b, budget.child, count)]
            elif open_ is not None and open_ + count(b) <= budget.child:
                kids[-1] = (kids[-1][0] + "\n" + b, False)
                open_ += count(b)
            else:
                kids.append((b, False))
                open_ = count(b)
        if len(kids) > 1 and count(kids[-1][0]) < budget.least and not kids[-1][1] and not kids[-2][1] and count(kids[-2][0] + "\n" + kids[-1][0]) <= budget.child:
            kids[-2:] = [(kids[-2][0] + "\n" + kids[-1][0], False)]
        whole = "\n".join(w)
        out += [("child", whole)] if [k for k, _ in kids] == [whole] else [("parent", whole), *(("child", k) for k, _ in kids)]
    return out


def test_chunking(spark):
    r = random.Random(2)
    budget = chunking.Budget(child=10, least=2, parent=40)
    text = lambda: " ".join(r.choice(["sales", "rose", "by", "net.", "The", "loss"]) for _ in range(r.choice([1, 2, 5, 9, 11, 25])))
    made, want = [], {}
    for d in range(12):
        runs = []
        for _ in range(r.randint(1, 4)):
            table, n = r.random() < 0.3, r.randint(1, 7)
            own = [text() for _ in range(n)]
            if not table:
                own[0] = f"{r.randint(1, 9)}. Heading of a part"
            runs.append((table, own))
        merged = []
        for table, own in runs:
            if table and merged and merged[-1][0]:
                merged[-1][1].extend(own)
            else:
                merged.append((table, list(own)))
        want[d] = [x for _, own in merged for x in slow_chunks(own, budget, seams.word_tokens)]
        made += [(d, o, f"e{d}-{o}", t, o // 3 + 1, "r1" if table else None) for o, (table, t) in enumerate((table, t) for table, own in merged for t in own)]
    made += [(50, 0, "x", "....................... 7", 1, None), (50, 1, "y", "  ", 1, None), (50, 2, "z", None, 1, None)]
    # three headings in a row are a list and open nothing
    made += [(60, i, f"h{i}", f"{i + 1}. Entry of a list", 1, None) for i in range(3)]
    want[60] = slow_chunks([f"{i + 1}. Entry of a list" for i in range(3)], budget, seams.word_tokens)
    blocks = spark.createDataFrame(made, "doc_id long, ordinal int, element_id string, text string, page_number int, region_id string")
    out = chunking.chunk(blocks, budget, seams.word_tokens).cache()
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x["doc_id"], x["ordinal"])):
        got.setdefault(x["doc_id"], []).append((x["role"], x["text"]))
    assert got == want
    assert chunking.misplaced(blocks, out).count() == 0 and chunking.uncontained(out).count() == 0 and chunking.out_of_order(blocks).count() == 0
    assert all(x["token_count"] <= 10 for x in out.filter("role = 'child'").collect())
    assert chunking.chunk(blocks.limit(0), budget).count() == 0
    assert chunking.misplaced(blocks, out.filter("doc_id <> 0")).count() == sum(m[0] == 0 for m in made)


def test_enriched_text_and_payload(spark):
    df = spark.createDataFrame([("c1", "g", "Acme", "annual_report", "FY24", "consolidated", "INR", "narrative", None, ["Notes", "Debt"], [3, 5], "body"), ("c2", "g", None, "", None, None, None, "table_derived", None, [], [], None)], "chunk_id string, generation_id string, issuer_name string, document_type string, fiscal_period string, reporting_basis string, currency string, evidence_type string, period_end date, heading_path array<string>, page_numbers array<int>, text string").withColumn("period_end", F.when(F.col("chunk_id") == "c1", F.to_date(F.lit("2025-03-31"))))
    got = {r["chunk_id"]: r["enriched"] for r in chunking.enriched(df).collect()}
    assert got == {"c1": "Issuer: Acme\nDocument: annual report\nPeriod: FY24\nBasis: consolidated\nCurrency: INR\nSection: Notes > Debt\nPages: 3-5\n\nbody", "c2": ""}
    payload = {r["chunk_id"]: r for r in chunking.filter_payload(df).collect()}
    assert (payload["c1"]["fiscal_year"], payload["c1"]["section"], payload["c2"]["section"], payload["c2"]["document_type"]) == (2025, "Notes", None, None)


def made_lists(r):
    ids = range(60)
    kind = {i: ("narrative", "table_derived")[r.random() < 0.4] for i in ids}
    lists = {name: {q: {i: round(r.random(), 1) for i in r.sample(ids, 30)} for q in range(5)} for name in ("bm25", "dense")}
    return kind, lists


def slow_hybrid(lists, kind, q, limit, names):
    score, best = {}, {}
    for name in names:
        own = {}
        for k in ("narrative", "table_derived"):
            hits = sorted(((-s, i) for i, s in lists[name][q].items() if kind[i] == k))[:limit]
            own[k] = [(i, n) for n, (_, i) in enumerate(hits, 1)]
        floor = max(1, min(round(0.6 * limit), limit - 1)) if limit > 1 else 1
        picked = own["narrative"][:floor] + own["table_derived"][: limit - floor]
        for k in ("narrative", "table_derived"):
            picked += [x for x in own[k] if x not in picked][: limit - len(picked)]
        for i, n in picked:
            score[i] = score.get(i, 0) + 1 / (60 + n)
            best[i] = min(best.get(i, n), n)
    return sorted(score, key=lambda i: (-round(score[i], 12), best[i], i))[:limit]


@pytest.mark.parametrize("limit", [1, 4, 20])
def test_hybrid(spark, limit):
    kind, lists = made_lists(random.Random(limit))
    frame = lambda name: spark.createDataFrame([(q, i, kind[i], s) for q, own in lists[name].items() for i, s in own.items()], "query_id long, chunk_id long, kind string, score double")

    def down():
        raise seams.Unavailable

    for dense, names, flags in ((lambda: frame("dense"), ("bm25", "dense"), ()), (down, ("bm25",), (hybrid.NO_DENSE,))):
        out = hybrid.hybrid(hybrid.lexical_with_fallback(lambda: frame("bm25"), down), dense, "chunk_id", limit)
        assert out.degraded == flags
        got = {}
        for r in out.rows.orderBy("query_id", "place").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        assert got == {q: slow_hybrid(lists, kind, q, limit, names) for q in range(5)}
    out = hybrid.lexical_with_fallback(down, lambda: frame("bm25"))
    assert out.degraded == (hybrid.LEXICAL_FALLBACK,) and out.retriever == "fts"
    assert hybrid.lexical_with_fallback(lambda: frame("bm25").limit(0), down).degraded == ()
    with pytest.raises(ValueError):
        hybrid.hybrid(out, down, "chunk_id", 0)


def test_rerank_and_final_window(spark):
    kind, lists = made_lists(random.Random(3))
    frame = lambda name: spark.createDataFrame([(q, i, kind[i], s) for q, own in lists[name].items() for i, s in own.items()], "query_id long, chunk_id long, kind string, score double")
    fused = hybrid.hybrid(hybrid.Hits(frame("bm25")), lambda: frame("dense"), "chunk_id", hybrid.window_depth(5))
    queries = spark.createDataFrame([(q, f"question {q}") for q in range(5)], "query_id long, text string")
    passages = spark.createDataFrame([(i, f"text {i}") for i in range(60) if i % 10], "chunk_id long, text string")
    ranked = hybrid.rerank(fused, queries, passages, "chunk_id", seams.stand_in_reranker)
    order = {}
    for r in ranked.rows.orderBy("query_id", "place").collect():
        order.setdefault(r["query_id"], []).append(r["chunk_id"])
    for q, own in order.items():
        score = dict(zip(own, seams.stand_in_reranker(f"question {q}", [f"text {i}" for i in own])))
        assert own == sorted(own, key=lambda i: (-score[i], i)) and not any(i % 10 == 0 for i in own)
    made = spark.range(1).select(hybrid.stand_in_score(F.lit("question 1"), F.lit("text 7")).alias("s")).first()["s"]
    assert made == pytest.approx(seams.stand_in_reranker("question 1", ["text 7"])[0], abs=1e-15)

    def down(query, texts):
        raise seams.Unavailable

    assert hybrid.rerank(fused, queries, passages, "chunk_id", down).degraded == (hybrid.NO_RERANKER,)
    assert hybrid.rerank(fused, queries, passages, "chunk_id", None).degraded == ()

    have = {i: [f"e{i // 3}", f"f{i}"] if i % 7 else [] for i in range(60)}
    elements = spark.createDataFrame([(i, e) for i, e in have.items()], "chunk_id long, elements array<string>")
    cites = spark.createDataFrame([(i, p, f"el{i}-{p}", f"p. {p}") for i in range(60) for p in (1, 0)], "chunk_id long, position int, element_id string, locator string")
    out = hybrid.final_window(ranked, elements, passages, cites, "chunk_id", 5)
    got = {}
    for r in out.rows.orderBy("query_id", "rank").collect():
        assert [c["position"] for c in r["citations"]] == [0, 1]
        got.setdefault(r["query_id"], []).append((r["chunk_id"], [(x["key"], x["shared"]) for x in r["absorbed"]]))
    for q, own in order.items():
        kept, gone = [], {}
        for i in own:
            owner = next((k for k in kept if set(have[k]) & set(have[i])), None)
            if owner is None:
                kept.append(i)
            else:
                gone.setdefault(owner, []).append((i, len(set(have[owner]) & set(have[i]))))
        assert got[q] == [(k, sorted(gone.get(k, []))) for k in kept[:5]]


def test_full_text(spark):
    texts = {1: "net sales rose while net debt fell", 2: "debt fell and sales of the net kind rose", 3: "sales rose", 4: "long-term debt", 5: "", 6: "net sales net sales"}
    df = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    found = lambda q: [r["chunk_id"] for r in fulltext.full_text(df, [(1, q)], "chunk_id").orderBy("rank").collect()]
    assert sorted(found("sales debt")) == [1, 2]
    assert set(found('"net sales"')) == {1, 6} and found('"net sales"')[0] == 6
    assert set(found("sales -debt")) == {3, 6}
    assert set(found('"net sales" OR "long term"')) == {1, 4, 6}
    assert found("-sales") == [] and found("") == [] and found("unseen") == []
    assert fulltext.cover_density("net sales rose".split(), fulltext.parse("net sales")) > fulltext.cover_density("net of tax sales".split(), fulltext.parse("net sales"))


def test_search_by_index(spark, tmp_path):
    r = random.Random(5)
    chunks = spark.createDataFrame([(i, " ".join(r.choice(["net", "sales", "debt", "tax", "rose", "fell", "of"]) for _ in range(r.randint(0, 12)))) for i in range(200)], "id long, text string")
    queries = spark.createDataFrame([(1, "net debt"), (2, "tax"), (3, "unseen")], "query_id long, text string")
    R.write_index(chunks, f"{tmp_path}/index", ["id"])
    index = spark.read.parquet(f"{tmp_path}/index")
    a = rows(R.search_index(index, queries, ["id"], 7), "query_id", "id", "score", "rank")
    post = R.postings(chunks, ["id"])
    assert a == rows(R.bm25(post, R.inverse_frequencies(post, 200), queries, ["id"], 7), "query_id", "id", "score", "rank")
    assert a == rows(R.bm25_search(chunks, queries, ["id"], 7), "query_id", "id", "score", "rank")
    plan = R.search_index(index, queries, ["id"], 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [part" in plan.replace("isnotnull(part", "[part") or "PartitionFilters" in plan


def test_best_chunks(spark):
    """What batches let through holds the k best, with ties, scopes, pools and kinds."""
    r = random.Random(15)
    made = [(i // 4, i, "ab"[i % 2], " ".join(r.choice(["net", "sales", "debt", "tax", "rose"]) for _ in range(r.randint(0, 6))) if i % 17 else None) for i in range(400)]
    chunks = spark.createDataFrame(made, "doc long, id long, kind string, text string").repartition(6)
    queries = spark.createDataFrame([(1, "net debt"), (2, "tax"), (3, "unseen"), (4, ""), (5, "rose net sales")], "query_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    full = R.bm25_search(chunks, queries, ["id"])
    assert rows(R.bm25_best(chunks, queries, ["id"], 7), "query_id", "id", "rank") == rows(full.filter("rank <= 7"), "query_id", "id", "rank")
    scope = chunks.filter("kind = 'a'")
    want = R.ranked(full.drop("rank").join(scope.select("id"), "id", "left_semi"), ["query_id"], [F.desc("score"), "id"], 7)
    assert rows(R.bm25_best(chunks, queries, ["id"], 7, scope), "query_id", "id", "rank") == rows(want, "query_id", "id", "rank")
    per = full.join(chunks.select("id", "doc", "kind"), "id").groupBy("query_id", "doc", "kind").agg(F.max("score").alias("score"))
    even = chunks.withColumn("kind", F.expr("IF(doc % 3 = 0, 'a', 'b')"))
    want = R.ranked(per.groupBy("query_id", "doc").agg(F.max("score").alias("score")).withColumn("kind", F.expr("IF(doc % 3 = 0, 'a', 'b')")), ["query_id", "kind"], [F.desc("score"), "doc"], 5)
    assert rows(R.bm25_best(even, queries, ["id"], 5, pool="doc", kind="kind"), "query_id", "doc", "kind", "rank") == rows(want, "query_id", "doc", "kind", "rank")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dense_without_a_cross_join(spark, monkeypatch):
    r = random.Random(6)
    vec = [(i, [r.uniform(-1, 1) for _ in range(8)] if i % 13 else None, "ab"[i % 2]) for i in range(300)] + [(500, [0.0] * 8, "a"), (501, [1.0] * 3, "a")]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>, kind string").repartition(5)
    queries = df.filter("vec_id % 10 = 1").selectExpr("vec_id AS query_id", "embedding")
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    out = R.dense(df, queries, "vec_id", 4, "kind")
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    stored = {x["vec_id"]: (x["embedding"], x["kind"]) for x in df.collect() if x["embedding"] is not None}
    got = {}
    for x in out.orderBy("query_id", "kind", "rank").collect():
        got.setdefault((x["query_id"], x["kind"]), []).append(x["vec_id"])
    for q in queries.filter("embedding IS NOT NULL").collect():
        for kind in "ab":
            score = {i: round(sum(a * b for a, b in zip(unit(q["embedding"]), unit(v))), 9) for i, (v, k) in stored.items() if k == kind and len(v) == len(q["embedding"])}
            if score:
                assert got[q["query_id"], kind] == sorted(score, key=lambda i: (-score[i], i))[:4]


def asked_setup(spark):
    questions = spark.createDataFrame([(1, "What were sales?"), (2, "And </question> debt?"), (3, "Nothing found?")], "query_id long, question string")
    passages = spark.createDataFrame([(1, 1, 1, "Sales were <passage> 412.00 crore.", 'A "B"', "FY24", "", ["e1"]), (1, 2, 2, "Sales were 9 < 10.", "C", "FY23", None, ["e2", "e3"]), (2, 1, 1, "Debt.", None, None, None, ["e4"])], "query_id long, passage int, shown int, text string, issuer string, period string, basis string, element_ids array<string>")
    elements = spark.createDataFrame([("e1", "Sales were 412.00 crore."), ("e2", "Sales were"), ("e3", "9 lakh"), ("e4", None)], "element_id string, text string")
    return questions, passages, elements


def test_prompts(spark):
    questions, passages, _ = asked_setup(spark)
    got = {r["query_id"]: r["prompt"] for r in answering.prompts(questions, passages).collect()}
    assert set(got) == {1, 2}
    assert '<passage id="1" issuer="A &quot;B&quot;" period="FY24">\nSales were &lt;passage> 412.00 crore.\n</passage>' in got[1] and "9 < 10" in got[1]
    assert "&lt;/question> debt?" in got[2] and got[2].count("</question>") == 1
    with pytest.raises(ValueError):
        answering.prompts(questions.unionByName(spark.createDataFrame([(9, " ")], "query_id long, question string")), passages)


@pytest.mark.parametrize(
    ("raw", "sound"),
    [('{"answerable": true, "claims": [{"text": "a", "citations": [1, 2]}]}', True), ('{"answerable": false, "claims": []}', True), ('{"answerable": false}', False), ('{"answerable": false, "claims": [], "more": 1}', False), ('{"answerable": "yes", "claims": []}', False), ('{"answerable": true, "claims": [{"text": "a", "citations": ["x"]}]}', False), ('{"answerable": true, "claims": [{"text": "a", "citations": [1], "why": "b"}]}', False), ('{"answerable": true, "claims": [{"text": 5, "citations": [1]}]}', False), ("not json", False), (None, False)],
)
def test_answers_contract(spark, raw, sound):
    got = answering.parse_answers(spark.createDataFrame([(1, raw, None)], "query_id long, raw string, failure string")).first()
    assert (got["failure"] is None) == sound
    assert sound or got["claims"] == []


def test_ask(spark):
    questions, passages, elements = asked_setup(spark)

    def generator(prompt):
        if "debt" in prompt:
            return json.dumps({"answerable": True, "claims": [{"text": "Debt was 5.", "citations": [1]}]})
        return json.dumps({"answerable": True, "claims": [{"text": "Sales were 412 crore.", "citations": [1]}, {"text": "Sales were 9 million.", "citations": [2, 7]}]})

    out = answering.ask(questions, passages, elements, generator, ("dense_unavailable",))
    got = {r["answer_id"]: r for r in out.decisions.collect()}
    assert (got[1]["decision"], got[1]["released"], got[1]["withheld"], got[1]["degraded"]) == ("partial", 1, 1, ["dense_unavailable"])
    assert "citation_not_in_evidence" in got[1]["reason_codes"] and "scale_not_in_cited_span" in got[1]["reason_codes"]
    assert got[2]["decision"] == "abstained" and "cited_span_has_no_text" in got[2]["reason_codes"]
    assert got[3]["reason_codes"] == [answering.NO_EVIDENCE] and got[3]["support_band"] == "none"
    cited = spark.createDataFrame([(1, 0, "e1")], "answer_id long, claim int, element_id string")
    audit = [tuple(r) for r in answering.audit_rows(out, None, cited).filter("answer_id = 1").orderBy("position").collect()]
    assert [(a[1], a[3], a[5]) for a in audit] == [(0, True, ["e1"]), (1, False, [])]
    for error, flag in ((seams.Unavailable(), answering.UNAVAILABLE), (seams.Truncated(), answering.TRUNCATED), (seams.WrongShape(), answering.BROKEN)):
        lost = {r["answer_id"]: r for r in answering.ask(questions, passages, elements, seams.StandInGenerator(fails=error)).decisions.collect()}
        assert (lost[1]["decision"], lost[1]["degraded"], lost[3]["degraded"]) == ("abstained", [flag], [])
    one = answering.ask(questions, passages, elements, seams.StandInGenerator()).decisions.filter("answer_id = 1").first()
    assert one["decision"] == "answered"


def test_evidence(spark):
    hits = spark.createDataFrame([(1, "c1", 1, "x" * 50), (1, "c2", 2, "y" * 300), (1, "c3", 3, "z" * 20), (1, "c4", 4, "w" * 200)], "query_id long, chunk_id string, rank int, text string")
    parents = spark.createDataFrame([("c1", "p1", "P" * 400), ("c3", "p1", "P" * 400)], "chunk_id string, parent_id string, parent_text string")
    details = spark.createDataFrame([(i, "A", "FY", "b", [f"e-{i}"]) for i in ("p1", "c2", "c4")], "passage_id string, issuer string, period string, basis string, element_ids array<string>")
    got = sorted((r["passage"], r["passage_id"], r["shown"], r["stands_for"]) for r in answering.evidence(hits, parents, details, 650).collect())
    assert got == [(1, "p1", 1, ["c1", "c3"]), (2, "c4", 2, ["c4"])]


def test_generations(spark, tmp_path):
    log = spark.createDataFrame([], generations.SCHEMA)
    add = lambda new: spark.createDataFrame([tuple(r) for r in [*log.collect(), *new.select(log.columns).collect()]], generations.SCHEMA)
    log = add(generations.open_shadow(log, "g1", "v", "c1", "r1"))
    with pytest.raises(generations.Refused):
        generations.open_shadow(log, "g9", "v", "c1", "r1")
    log = add(generations.activate(log, "g1"))
    log = add(generations.open_shadow(log, "g2", "v", "c2"))
    with pytest.raises(generations.Refused):  # no run yet
        generations.activate(log, "g2")
    log = add(generations.attach_run(log, "g2", "r2"))
    log = add(generations.fail(log, "g2"))
    log = add(generations.reopen(log, "g2"))
    outbox = spark.createDataFrame([("g2", "completed"), ("g2", "completed")], "generation_id string, state string")
    short = generations.finish(log, "g2", outbox, spark.createDataFrame([("g2",)], "generation_id string"))
    assert short.first()["state"] == generations.FAILED
    log = add(generations.finish(log, "g2", outbox, spark.createDataFrame([("g2",), ("g2",)], "generation_id string")))
    assert rows(generations.current(log), "generation_id", "state") == [("g1", "superseded"), ("g2", "active")]
    with pytest.raises(generations.Refused):  # an active one can't fail
        generations.fail(log, "g2")
    assert [r[0] for r in generations.prunable(log).collect()] == ["g1"]
    points = spark.createDataFrame([(g, f"{g}{i}", [1.0], ["t"], [0.5]) for g in ("g1", "g2") for i in range(3)], "generation_id string, chunk_id string, vector array<float>, terms array<string>, weights array<double>")
    at = f"{tmp_path}/points"
    assert sinks.upsert_points(points, at) == 6 and sinks.upsert_points(points, at) == 0
    with pytest.raises(ValueError):
        sinks.upsert_points(points.withColumn("weights", F.array(F.lit(1.0), F.lit(2.0))), at)
    sinks.ensure_index(spark, at, 1)
    with pytest.raises(ValueError):
        sinks.ensure_index(spark, at, 2)
    assert generations.prune(spark, log, at).points_prunable == 3
    done = generations.prune(spark, log, at, confirm=True)
    assert (done.removed, done.points_after, done.active_before) == (3, 3, 3)
    chunks = spark.createDataFrame([("g2", "child"), ("g2", "parent"), ("g2", "child")], "generation_id string, role string")
    assert tuple(generations.index_consistency(log, chunks, spark.read.parquet(at)).first()) == (3, 2, False)
    assert tuple(generations.index_consistency(log, chunks, None).first()) == (None, 2, None)


def test_runs(spark):
    runs = spark.createDataFrame([], generations.RUN_SCHEMA)
    first = generations.start_run(runs, "r1", "v", "c", 1)
    assert first.first()["state"] == "failed" and generations.current_runs(first).count() == 0
    elements = spark.createDataFrame([("a", None), ("b", "unreadable")], "text string, failure_reason string")
    log = first.unionByName(generations.complete_run(first, "r1", elements, 2))
    assert generations.current_runs(log).first()["state"] == "partial"
    assert generations.run_state(elements.limit(0)) == "failed" and generations.run_state(elements.filter("failure_reason IS NULL")) == "succeeded"
    with pytest.raises(generations.Refused):
        generations.start_run(log, "r2", "v", "c")


def test_element_tree(spark, tmp_path):
    leaf = "struct<element_type:string,text:string,failure_reason:string,row_index:int,column_index:int>"
    middle = f"struct<element_type:string,text:string,failure_reason:string,caption:string,children:array<{leaf}>>"
    cell = ("cell", "5", None, 0, 1)
    page = ("page", "p", None, [("block", "b", None, None, []), ("table", "t", None, "cap", [cell, cell])])
    pages = spark.createDataFrame([("r", 0, page), ("r", 1, page)], f"run_id string, ordinal int, element struct<element_type:string,text:string,failure_reason:string,children:array<{middle}>>")
    flat = sinks.flattened(pages).cache()
    assert flat.count() == 10 and flat.select("element_id").distinct().count() == 10
    assert rows(flat.groupBy("depth").count(), "depth", "count") == [(0, 2), (1, 4), (2, 4)]
    assert flat.join(flat.select(F.col("element_id").alias("parent_id")), "parent_id", "left_semi").count() == 8
    assert sinks.record_elements(flat, f"{tmp_path}/t") == 10
    assert spark.read.parquet(f"{tmp_path}/t/cells").count() == 4 and spark.read.parquet(f"{tmp_path}/t/tables").first()["caption"] == "cap"
    assert sinks.invalid_elements(flat).count() == 0
    assert rows(sinks.invalid_elements(flat.withColumn("failure_reason", F.lit("x")).filter("depth = 0")), "rule") == [("text_xor_failure",)] * 2


def test_chunk_sink_and_cache(spark, tmp_path):
    blocks = spark.createDataFrame([(1, i, f"e{i}", "word " * 9, 1, None) for i in range(6)], "doc_id long, ordinal int, element_id string, text string, page_number int, region_id string")
    out = chunking.chunk(blocks, chunking.Budget(child=20, least=2, parent=60), seams.word_tokens)
    sinks.record_chunks(out, f"{tmp_path}/c", "g1", "v1", "2")
    chunks, outbox = spark.read.parquet(f"{tmp_path}/c/chunks"), spark.read.parquet(f"{tmp_path}/c/outbox")
    children = chunks.filter("role = 'child'")
    assert outbox.count() == children.count() > 0 and outbox.join(children, "chunk_id", "left_anti").count() == 0
    assert spark.read.parquet(f"{tmp_path}/c/chunk_sources").select("source_element_id").distinct().count() == 6
    assert children.filter("parent_id IS NOT NULL").join(chunks.selectExpr("chunk_id AS parent_id"), "parent_id", "left_anti").count() == 0
    vectors = spark.createDataFrame([("d1", "m", "1", "doc", [1.0]), ("d1", "m", "1", "doc", [2.0]), ("d2", "m", "1", "doc", [3.0])], "digest string, model string, config string, kind string, vector array<double>")
    assert sinks.cache_vectors(vectors, f"{tmp_path}/v") == 2 and sinks.cache_vectors(vectors, f"{tmp_path}/v") == 0
    decided = spark.createDataFrame([(1, "abstained", 1)], "answer_id long, decision string, released int")
    with pytest.raises(ValueError):
        sinks.record_answers(decided, decided, f"{tmp_path}/a")
    sinks.record_answers(decided.withColumn("released", F.lit(0)), decided, f"{tmp_path}/a")
    sinks.write_report(decided, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first()["decision"] == "abstained"


def test_intake(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    files = {"a.pdf": b"%PDF-1.7 one", "copy.pdf": b"%PDF-1.7 one", "b.txt": b"hello", "c.pdf": b"<html>no</html>", "d.exe": b"MZ", "e.txt": b"", "f.txt": b"x" * 100, "g.xlsx": b"PK\x03\x04zip"}
    for name, raw in files.items():
        (inbox / name).write_bytes(raw)
    got = {r["original_filename"]: r["rejected"] for r in intake.received(spark, str(inbox), 50).collect()}
    assert got == {"a.pdf": None, "copy.pdf": None, "b.txt": None, "c.pdf": "type_disagrees", "d.exe": "unknown_type", "e.txt": "empty", "f.txt": "too_large", "g.xlsx": None}
    none = spark.createDataFrame([], "content_hash string")
    store = f"file://{tmp_path}/store"
    rows_ = intake.intake(spark, str(inbox), store, none, 50).collect()
    assert len(rows_) == 3
    for r in rows_:
        assert (tmp_path / "store" / r["object_key"]).stat().st_size == r["byte_size"]
    known = spark.createDataFrame([(r["content_hash"],) for r in rows_], "content_hash string")
    assert intake.intake(spark, str(inbox), store, known, 50).count() == 0
    wrong = spark.createDataFrame([(f"file://{inbox}/b.txt", rows_[0]["object_key"], 999)], "path string, object_key string, byte_size long")
    with pytest.raises(Exception, match="is there with"):
        intake.put_if_absent(wrong, store).collect()
    import hashlib

    entries = spark.createDataFrame([("one", "train", "a.pdf", hashlib.sha256(files["a.pdf"]).hexdigest(), 12), ("two", "train", "b.txt", "0" * 64, 5), ("three", "train", "zz.txt", "0" * 64, 5), ("four", "train", "f.txt", "0" * 64, 5)], "entry_id string, split string, path string, content_hash string, byte_size long")
    assert dict(rows(intake.verified(spark, entries, str(inbox)), "entry_id", "fault")) == {"one": None, "two": "digest", "three": "missing", "four": "size"}
    with pytest.raises(PermissionError):
        intake.verified(spark, entries.withColumn("split", F.lit(intake.HELD_OUT)), str(inbox))
    assert intake.for_split(entries, "train").count() == 4 and intake.by_id(entries, "two").count() == 1


def test_manifest_rules(spark):
    schema = "entry_id string, split string, path string, content_hash string, byte_size long, issuer string, frozen_at string, supersedes string"
    sound = ("a-1", "train", "p", "0" * 64, 5, "I", None, None)
    df = spark.createDataFrame([sound, ("B 2", "held_out", " ", "x", 0, "", None, "gone"), ("a-1", "test", "q", "0" * 64, 5, "I", None, "a-1")], schema)
    assert rows(intake.invalid_entries(df), "entry_id", "rule") == sorted(("B 2", r) for r in ("entry_id", "byte_size", "content_hash", "frozen_at", "issuer", "path"))
    assert rows(intake.broken_corpus_rules(df), "rule", "what") == [("issuer_in_several_splits", "I"), ("repeated_id", "a-1"), ("supersedes_nothing", "gone")]
    assert rows(intake.unrecorded_fields(df.withColumn("issuer", F.lit(" Unknown ")), ["issuer", "path"]), "entry_id", "unrecorded")[0] == ("B 2", ["issuer", "path"])


def test_scales_are_words(spark):
    got = spark.range(1).select(evidence._scales(F.lit("Rs 5 crores, a millionaire and 2 Lakhs")).alias("s")).first()["s"]
    assert got == ["crore", "lakh"]


def test_stand_ins():
    embed = seams.stand_in_embedder(20)
    a, b = embed(["x", "y"])
    assert len(a) == 20 and a == embed(["x"])[0] != b and sum(v * v for v in a) == pytest.approx(1)
    keep = seams.Recorder()
    keep("search", 0.5)
    keep("rerank", 1.0)
    assert keep.total() == 1.5
