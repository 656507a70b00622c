"""Analysis and search: the stemmer, positions and pruned searches against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from brightvein.functions import analysis
from brightvein.operators import block_max, evidence, fulltext, ledger, resolution, tables, vector_index
from brightvein.operators import retrieval as R
from brightvein.plans import registry

FOLDER = "/root/testdata/sf0.001"
VOWELS = set("aeiouy")


def region(w, start):
    """Where the region after the first consonant that follows a vowel begins."""
    return next((i + 1 for i in range(start + 1, len(w)) if w[i] not in VOWELS and w[i - 1] in VOWELS), len(w))


def short_end(w):
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS and w[-1] not in "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def plain_stem(w):
    """The published rules by positions, one ending at a time."""
    if len(w) < 3 or w in analysis.UNCHANGED:
        return w
    if w in analysis.IRREGULAR:
        return analysis.IRREGULAR[w]
    letters = list(w)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    w = "".join(letters)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(w, 0)
    r2 = region(w, r1)
    longest = lambda endings: max((e for e in endings if w.endswith(e)), key=len, default="")
    end = longest(("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and VOWELS & set(w[:-2]):
        w = w[:-1]
    if w in analysis.SETTLED:
        return w
    end = longest(("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end.startswith("eed"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and VOWELS & set(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif r1 >= len(w) and short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    table = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
    end = longest(table)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(end)] + table[end]
    table = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
    end = longest(table)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + table[end]
    end = longest("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        w = w[:-1] if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1]) else w
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Published pairs of words and stems.
PAIRS = "consign consign consigned consign consistency consist consolation consol knightly knight knots knot generate generat generously generous communities communiti happy happi revenue revenu operations oper hopping hop hoping hope national nation ties tie cries cri gas gas this this gaps gap kiwis kiwi feed feed luxuriated luxuri by by say say relational relat adoption adopt controlled control proceeds proceed dying die".split()


def test_stems(spark):
    """Every word of all documents, published pairs, and words made of the endings that rules know."""
    for w, s in zip(PAIRS[::2], PAIRS[1::2]):
        assert plain_stem(w) == s
    r = random.Random(4)
    parts = "b st gener commun arsen at iz en anc e a o y l t ed ing ly li ation ational tional ness ful ous ive ment ement ion s ies eed al ize ical icate iti abl bl er ent ogi ll é w x".split()
    words = {"".join(r.choice(parts) for _ in range(r.randint(1, 6))) for _ in range(20_000)} | set(PAIRS[::2])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words |= {x[0] for x in docs.select(F.explode(analysis.words(F.col("text")))).distinct().collect()}
    words = {w for w in words if "yyy" not in w}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", analysis.stem(F.col("w")).alias("s")).collect()
    assert len(got) > 20_000 and [(x["w"], x["s"]) for x in got if x["s"] != plain_stem(x["w"])] == []


def test_words_of_all_scripts(spark):
    one = lambda t, c="simple": spark.range(1).select(analysis.analysed(F.lit(t), c).alias("t")).first()["t"]
    assert one("für die Größe, niño: 1,23,456.50 x2") == ["für", "die", "größe", "niño", "123456.50", "x", "2"]
    assert one("Δελφοί finan-cial 2023-24 state-of-the-art") == ["δελφοί", "finan", "cial", "2023", "24", "state", "of", "the", "art", "financial", "stateoftheart"]
    assert one("The operations of the companies were generously financed", "english") == ["oper", "compani", "generous", "financ"]
    assert one("") == [] and one("...") == []
    with pytest.raises(analysis.UnknownConfig):
        one("x", "klingon")


def test_stemmed_search(spark, tmp_path):
    """Query and chunk meet at their stems, from an index and without one, and stop words find nothing."""
    chunks = spark.createDataFrame([(1, "net operations of companies"), (2, "the operating company grew"), (3, "of the and"), (4, "Die Größe")], "id long, text string")
    asked = spark.createDataFrame([(1, "operation"), (2, "company's"), (3, "the"), (4, "GRÖSSE größe")], "query_id long, text string")
    R.write_index(chunks, f"{tmp_path}/i", ["id"], config="english")
    want = {(1, 1), (1, 2), (2, 1), (2, 2), (4, 4)}
    for hits in (R.search_index(spark.read.parquet(f"{tmp_path}/i"), asked, ["id"], 5, config="english"), R.bm25_search(chunks, asked, ["id"], 5, config="english"), R.bm25_best(chunks, asked, ["id"], 5, config="english")):
        assert {(r["query_id"], r["id"]) for r in hits.collect()} == want


def test_full_text_is_the_definition(spark, tmp_path):
    """50 queries of every form, made of benchmark texts, over an index with positions."""
    blocks = R.blocks(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    R.write_index(blocks, f"{tmp_path}/i", ["doc_id", "ordinal"], positions=True)
    index = spark.read.parquet(f"{tmp_path}/i")
    r, asked = random.Random(1), []
    texts = [x["text"] for x in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(50).collect()]
    for i in range(50):
        w = [x.strip(".,") for x in texts[i % len(texts)].split()]
        a = r.randrange(max(len(w) - 6, 1))
        asked.append((i, [texts[i % len(texts)], f"{w[0]} {w[a]}", f'"{" ".join(w[a : a + 3])}"', f'{w[a]} -{w[0]} OR "{w[1]} {w[2]}" {w[a]}', f'{w[a]} {w[a]} -"{w[0]} {w[1]}"'][i % 5]))
    plain = [(x["doc_id"], x["ordinal"], x["ts"]) for x in blocks.select("doc_id", "ordinal", analysis.analysed(F.col("text")).alias("ts")).collect()]
    want = {(i, d, o): round(s, 9) for i, q in asked for d, o, ts in plain if (s := fulltext.cover_density(ts, fulltext.parse(q))) is not None}
    got = {(x["query_id"], x["doc_id"], x["ordinal"]): x["score"] for x in fulltext.search_positions(index, asked, ["doc_id", "ordinal"]).collect()}
    assert got == pytest.approx(want) and len({i for i, _, _ in got}) > 10
    assert {(x["query_id"], x["doc_id"], x["ordinal"]): x["score"] for x in fulltext.full_text(blocks, asked, ["doc_id", "ordinal"]).collect()} == got
    assert "PythonUDF" not in (p := fulltext.search_positions(index, asked, ["doc_id", "ordinal"])._jdf.queryExecution().toString()) and "Python" not in p


def test_full_text_with_stop_words(spark):
    chunks = spark.createDataFrame([(1, "the bank of India lends"), (2, "bank India"), (3, "banks in India")], "id long, text string")
    found = lambda q: {r["id"] for r in fulltext.full_text(chunks, [(1, q)], "id", config="english").collect()}
    assert found('"bank of india"') == {1, 3} and found("the lending bank") == {1} and found("the of") == set() and found("banking -lend") == {2, 3}
    post = R.postings(chunks, ["id"], config="english", positions=True)
    kept = lambda q: {r["id"] for r in fulltext.search_positions(post, [(1, q)], ["id"], config="english").collect()}
    assert kept('"bank of india"') == {1, 3} and kept("the lending bank") == {1} and kept("the of") == set() and kept("banking -lend") == {2, 3}


def test_cover_density_query(spark):
    hits = registry.QUERIES["g9_cover_density"](spark, FOLDER).collect()
    found = {(r["query_id"], r["doc_id"], r["ordinal"]) for r in registry.QUERIES["g9_boolean_search"](spark, FOLDER).collect()}
    assert hits and {(r["query_id"], r["doc_id"], r["ordinal"]) for r in hits} <= found and all(re.fullmatch(r"\d+", str(r["rank"])) for r in hits)


def test_block_max_is_bm25(spark, tmp_path):
    """Same rows as the whole search, also with a filter, ties, few hits and unseen terms; far fewer blocks."""
    r = random.Random(7)
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    common = [f"w{letters(i)}" for i in range(30)]
    topic = lambda i: [f"t{letters(i // 40)}x{letters(j)}" for j in range(12)]
    rows = [(i, i % 3, " ".join(r.choice(common + topic(i) * 3) for _ in range(r.randint(0, 25)))) for i in range(1600)]
    rows += [(5000 + i, 0, rows[7][2]) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, kind int, text string").withColumn("topic", F.floor(F.col("id") / 40))
    asked = [(1, "wb wc tdxe"), (2, "tfxb tfxc tfxd wh"), (3, "unseen"), (4, rows[7][2]), (5, "tjxb"), (6, None), (7, " ".join(common))]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    block_max.write_blocks(chunks, f"{tmp_path}/b", ["id", "kind"], ["topic"], buckets=8, rows=16)
    index = block_max.Blocks(spark, f"{tmp_path}/b", 8)
    key = lambda df: sorted((x["query_id"], x["id"], x["rank"], round(x["score"], 6)) for x in df.collect())
    assert key(index.search(queries, ["id", "kind"], 7)) == key(R.bm25_search(chunks, queries, ["id", "kind"], 7))
    scoped = R.bm25_best(chunks, queries, ["id", "kind"], 7, chunks.filter("kind = 1"))
    assert key(index.search(queries, ["id", "kind"], 7, F.col("kind") == 1)) == key(scoped)
    read = {x["query_id"]: (x["blocks_read"], x["blocks_of_terms"]) for x in index.blocks_read(queries, ["id", "kind"], 7).collect()}
    assert all(a <= b for a, b in read.values()) and read[2][0] < read[2][1] / 4 and read[5][0] == read[5][1] < 8
    block_max.write_blocks(chunks.limit(0), f"{tmp_path}/none", ["id"], buckets=8)
    assert block_max.Blocks(spark, f"{tmp_path}/none", 8).search(queries, ["id"], 5).collect() == []
    terms = ["w1", "é", "long term of bytes", "2024"]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(64)).alias("p")).collect()
    assert {x["t"]: x["p"] for x in got} == {t: R.part_of(t, 64) for t in terms}


def test_blocks_read(spark):
    """Over `documents`, whose words are few and all frequent, whole passages as queries leave little unread."""
    rows = registry.QUERIES["f5_blocks_read"](spark, FOLDER).collect()
    assert rows and all(r["postings_read"] <= r["postings_of_terms"] for r in rows) and sum(r["blocks_read"] for r in rows) < sum(r["blocks_of_terms"] for r in rows)


def test_vector_index(spark, tmp_path):
    """Recall of 0.9 or more against the exact search; exact with all lists; every row is in a list."""
    for folder in (FOLDER, "/root/testdata/sf0.1"):
        got = registry.QUERIES["a26_vector_index_recall"](spark, folder).agg(F.sum("found"), F.sum("wanted")).first()
        assert got[0] >= 0.9 * got[1]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "a"), (5, None, "a"), (None, [1.0, 1.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (7, [], "a"), (8, [0.0, 0.0], "a")], "id long, embedding array<float>, kind string")
    vector_index.write_vectors(vectors, f"{tmp_path}/v", "id", ["kind"], lists=2)
    assert spark.read.parquet(f"{tmp_path}/v/rows").count() == 7
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "query_id long, embedding array<float>")
    found = lambda **o: sorted((r["query_id"], r["rank"], r["id"]) for r in vector_index.Vectors(spark, f"{tmp_path}/v").search(asked, "id", 3, 9, **o).collect())
    assert found() == [(1, 1, 1), (1, 2, 4), (1, 3, 2), (2, 1, 6)]
    assert found(where=F.col("kind") == "b") == [(1, 1, 2)]
    vector_index.write_vectors(vectors.limit(0), f"{tmp_path}/none", "id")
    assert vector_index.Vectors(spark, f"{tmp_path}/none").search(asked, "id", 3).collect() == []


def test_exact_search_without_batches(spark):
    """The k best of a task don't depend on its batches."""
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 1.0]) for _ in range(4)], f"k{i % 2}") for i in range(500)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, kind string").repartition(2)
    queries = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    chunks = spark.createDataFrame([(i, f"g{i % 7}", f"k{i % 7 % 2}", " ".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))) for i in range(500)], "id long, g string, kind string, text string").repartition(2)
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f a")], "query_id long, text string")
    runs = []
    for n in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        runs.append([sorted(map(tuple, df.collect())) for df in (R.dense(vectors, queries, "id", 5), R.dense(vectors, queries, "id", 5, "kind"), R.bm25_best(chunks, asked, ["id"], 6), R.bm25_best(chunks, asked, ["id"], 6, pool="g", kind="kind"), R.bm25_best(chunks, asked, ["id"], 6, kind="kind"))])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert runs[0] == runs[1]
    assert runs[0][2] == sorted(map(tuple, R.bm25_search(chunks, asked, ["id"], 6).collect()))


def test_documents_by_their_blocks(spark):
    """Both lists are those of scores summed up after a whole search, whatever the batches are."""
    r = random.Random(8)
    rows = [(i, None if i == 3 else "\n".join(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 5)))) for i in range(300)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "a b"), (2, "h"), (3, "zzz"), (4, None)], "query_id long, text string")
    chunks = docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    per = R.bm25_search(chunks, asked, ["doc_id", "ordinal"]).groupBy("query_id", "doc_id").agg(F.max("score").alias("best"), F.round(F.sum("score"), 6).alias("total")).collect()
    n = chunks.count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    got = R.bm25_documents(docs.filter("doc_id IS NOT NULL"), asked, "doc_id", 6).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert n > 600 and {tuple(x) for x in got} <= {tuple(x) for x in per}
    for q in (1, 2):
        for c in ("best", "total"):
            top = lambda rs: [x["doc_id"] for x in sorted((x for x in rs if x["query_id"] == q), key=lambda x: (-x[c], x["doc_id"]))][:6]
            assert top(got) == top(per) and len(top(got)) == 6


def test_resolution_either_way(spark):
    """The automaton and the join by words find the same names; shared ones are ambiguous."""
    texts = spark.createDataFrame([(1, "Bank of India and the STATE Bank."), (2, "bankof india"), (3, None), (4, "state bank of india, state-bank"), (5, "")], "id long, text string")
    aliases = spark.createDataFrame([("bank of India", 1), ("State Bank", 2), ("state  bank", 3), ("India", 4), ("", 5), (None, 6), ("bank", None)], "alias string, entity long")
    want = [(1, "bank of india", [1], "resolved"), (1, "india", [4], "resolved"), (1, "state bank", [2, 3], "ambiguous"), (2, "india", [4], "resolved"), (4, "bank of india", [1], "resolved"), (4, "india", [4], "resolved"), (4, "state bank", [2, 3], "ambiguous")]
    for most in (100, 0):
        assert sorted(map(tuple, resolution.resolve(texts, aliases, "id", most=most).collect())) == want
    assert resolution.resolve(texts, aliases.limit(0), "id").count() == 0


def test_facts(spark):
    shown = [("1,234.50", None), ("(45)", None), ("0.00", None), ("-", None), ("Nil", None), ("n/a", None), ("", None), (None, None), ("1.2.3", None), ("abc", None), ("9" * 30, None), ("₹ 2.5", "crore"), ("7", "dozen"), ("9" * 25, "billion")]
    got = [(r["state"], None if r["value"] is None else str(r["value"].normalize()), r["places"]) for r in ledger.facts(spark.createDataFrame([(i, *s) for i, s in enumerate(shown)], "i int, displayed string, scale string"), scale="scale").orderBy("i").collect()]
    assert got == [("numeric", "1234.5", 2), ("numeric", "-45", 0), ("zero", "0", 2), ("nil", None, 0), ("nil", None, 0), ("not_applicable", None, 0), ("missing", None, 0), ("missing", None, 0), ("parse_failure", None, 1), ("parse_failure", None, 0), ("parse_failure", None, 0), ("numeric", "2.5E+7", 1), ("parse_failure", None, 0), ("parse_failure", None, 0)]
    rows = [("a", "5"), ("a", "(5)"), ("b", "12"), ("b", "1200"), ("c", "1.23"), ("c", "1.2"), ("d", "5"), ("d", "6"), ("d", "nil"), ("e", "7"), ("e", "7.0"), ("f", "0"), ("f", "3")]
    known = ledger.facts(spark.createDataFrame(rows, "k string, displayed string"))
    assert {r["k"]: (r["kind"], r["material"], r["facts"]) for r in ledger.conflicts(known, ["k"]).collect()} == {"a": ("sign", True, 2), "b": ("scale", True, 2), "c": ("rounding", False, 2), "d": ("value", True, 2), "f": ("value", True, 2)}


def test_guards(spark):
    made = spark.createDataFrame([(1, 1, "100"), (1, 2, "150"), (1, 4, "75"), (1, 5, "-5"), (1, 6, "0"), (1, 7, "9"), (1, 8, None), (1, 9, "4"), (2, 3, "8"), (3, 1, "100"), (3, 3, "121"), (4, 1, "-1"), (4, 2, "5")], "k int, p int, v string").withColumn("v", F.col("v").cast("decimal(38,10)"))
    got = {(r["k"], r["p"]): (r["guard"], None if r["growth"] is None else float(r["growth"])) for r in ledger.growth(made, ["k"], "p", "v").collect()}
    assert [got[1, p] for p in (1, 2, 4, 5, 6, 7, 8, 9)] == [("no_previous", None), (None, 0.5), ("period_gap", None), ("sign_change", None), (None, 1.0), ("zero_base", None), ("missing", None), ("missing", None)]
    ends = {r["k"]: (r["guard"], r["cagr"]) for r in ledger.compound_growth(made, ["k"], "p", "v").collect()}
    assert ends == {1: (None, pytest.approx((4 / 100) ** (1 / 8) - 1)), 2: ("one_period", None), 3: (None, pytest.approx(0.1)), 4: ("not_positive", None)}
    x = ledger.ratio(F.lit(1).cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)"))
    assert spark.range(1).select(x.alias("x")).first()["x"]["guard"] == "zero_denominator"


def test_row_groups_and_regions(spark):
    rows = spark.createDataFrame([("t", i, "x" * (3 + i % 4)) for i in range(50)] + [("u", 0, "y" * 500)], "t string, i long, text string")
    header = spark.createDataFrame([("t", "head"), ("u", "h")], "t string, header string")
    got = sorted(tables.row_groups(rows, header, ["t"], "i", limit=40).collect(), key=lambda r: (r["t"], r["first_row"]))
    assert all(len(r["text"]) <= 40 and r["text"].startswith("head\n") for r in got if r["t"] == "t") and got[-1]["text"] == "h\n" + "y" * 500
    assert [r["first_row"] for r in got if r["t"] == "t"][1:] == [r["last_row"] + 1 for r in got if r["t"] == "t"][:-1]
    hits = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 9), (1, 9), (2, 4)], "d int, ordinal int")
    extents = spark.createDataFrame([(1, 0, 9), (2, 0, 30)], "d int, low int, high int")
    assert sorted(map(tuple, evidence.neighbourhoods(hits, extents, ["d"]).collect())) == [(1, 0, 4, 3), (1, 8, 9, 2), (2, 3, 5, 1)]
