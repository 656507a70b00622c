"""Whole methods against plain Python, clashing names, repeated rows, very long texts, and each stage of the pipeline."""

import bisect
import collections
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from brightvein.llm import _shared, chat, fingerprints, licenses, mixing, ngram_join, packing, pii, quality, secrets, token_files
from brightvein.llm._encode import encoder

from test_llm import WORD, brute_components, luhn, prose

CLASH = ["__bv_text", "__BV_words", "__bv_host", "__bv_condemned", "__bv_q_kept", "__bv_spans", "__pii_text", "__pii_base", "__fp_terms", "stay_id", "nth", "row", "due", "copies", "label", "th", "cid", "tokens", "k0", "s", "acc"]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(21)
    base = [prose(r, 60) for _ in range(30)]
    texts = [None, "", *base, *base[:10], *(" ".join([*t.split()[:-1], "else"]) for t in base[:10]), "mail a.b@example.org or call 415-555-2671", 'secret = "aB3dE5fG7hI9" ' + prose(r, 30)]
    rows = [(i if i % 9 else None, t, f"s{i % 2}", *(["KEEP"] * len(CLASH))) for i, t in enumerate(texts)]
    rows += [(5, base[4], "s0", *(["KEEP"] * len(CLASH))), (5, "another text " * 9, "s0", *(["KEEP"] * len(CLASH)))]
    names = ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}").selectExpr("*", "map('a', 1) AS held").repartition(3)


@pytest.mark.parametrize(
    "apply",
    [
        quality.keep_good,
        lambda d: pii.find_personal_data(d, out="spans"),
        lambda d: fingerprints.with_fingerprint(d, fingerprints.build_lexicon(d), out="sigs"),
        ngram_join.one_of_each,
        lambda d: secrets.find_secrets(d, out="spans"),
        mixing.mixed_rows,
        lambda d: corpus_pipeline.secret_stage(d.sparkSession, d, ""),
        pii.redact,
    ],
    ids=["quality", "pii", "fingerprints", "one_of_each", "secrets", "mixed_rows", "secret_stage", "redact"],
)
def test_columns_of_any_name_stay(clashing, apply):
    out = apply(clashing)
    rows = out.collect()
    assert rows and set(clashing.columns) <= set(out.columns)
    assert all(r[c] == "KEEP" for r in rows for c in CLASH)


def test_one_of_each_with_repeated_ids(spark):
    """An id may be used for several texts; what is a copy goes by its text."""
    r = random.Random(3)
    a, b, c = prose(r, 50), prose(r, 50), prose(r, 50)
    rows = [(5, a), (1, a), (5, b), (None, c), (None, c), (None, None), (7, ""), (7, "")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (5, b), (None, c), (None, None), (7, "")], key=str)


def test_many_equal_rows(spark):
    """20,000 rows alike are mixed in about the time of as many different ones, and as often as the target says."""
    same = spark.range(20_000).selectExpr("CAST(NULL AS long) AS doc_id", "'three words here' AS text", "IF(id % 4 = 0, 'a', 'b') AS source")
    start = time.time()
    got = mixing.mix(same).groupBy("source").agg({"copies": "sum", "target": "max", "*": "count"}).collect()
    assert time.time() - start < 60
    for r in got:
        assert abs(3 * r["sum(copies)"] - r["max(target)"]) <= 3
    assert sum(r["count(1)"] for r in got) == 20_000


def test_very_long_texts(spark, tmp_path):
    """A text longer than any step and block goes whole through every operator."""
    r = random.Random(4)
    part = [prose(r, 2000) for _ in range(40)]
    long = " ".join(r.choice(part) for _ in range(400)) + " mail x.y@example.org end"
    assert len(long) > 4 << 20
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " more", "s"), (3, "short text", "s")], "doc_id long, text string, source string")
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.similar_documents(docs).collect()} == {1: 1, 2: 1, 3: 3}
    found = {x["doc_id"]: x["spans"] for x in pii.find_personal_data(docs).select("doc_id", "spans").collect()}
    assert [(s["k"], s["s"]) for s in found[1]] == [("email", long.index("x.y@"))]
    assert [x["n_words"] for x in quality.quality_rules(docs, carry=["doc_id"]).orderBy("doc_id").collect()][0] == len(long.split())
    ids = encoder().tokenizer.encode(long, add_special_tokens=False).ids
    manifest = token_files.write_token_files(docs, path=f"file://{tmp_path}/t")
    assert token_files.read_token_files(manifest).filter("doc_id = 1").first()["n_tokens"] == len(ids) + 1
    pieces = packing.pack_documents(docs).filter("doc_id = 1").collect()
    assert sum(p["length"] for p in pieces) == len(ids) + 1
    assert secrets.find_secrets(docs).count() == 3 and licenses.scan_licenses(docs).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "#" + long)], "conv_id long, turn long, role string, text string")
    parts = sorted((p["part"], p["text"]) for p in chat.format_chat(turns).collect())
    assert [t for _, p in parts for t in chat.read_turns(p)] == [("user", long), ("assistant", "#" + long)]


def test_a_shared_folder_is_asked_for():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Cluster())


FORMS = {k: re.compile(p) for k, p in pii.WIDE.items()}


def plain_features(kind, m, b, a):
    """The features of a candidate, written out anew."""
    digits = re.sub("[^0-9]", "", m)
    bare = m.replace(" ", "")
    turned = bare[4:] + bare[:4]
    checked = kind == "iban" and int("".join(str(int(c, 36)) if c.isupper() else c for c in turned if c.isdigit() or c.isupper())) % 97 == 1
    near = lambda words: re.search(rf"({words})[^0-9A-Za-z]*([a-z]+[^0-9A-Za-z]*){{0,2}}$", b, re.I) is not None
    return [
        len(digits), len(re.sub("[^A-Za-z]", "", m)), len(re.sub(r"[^ .()\[\]:-]", "", m)), max(len(set(digits)), 1),
        near("phone|tel|call|fax|mobile|ssn|social|security|iban|account|mail|contact|reach|write|device|adapter|mac|hardware"),
        near("order|invoice|version|isbn|ref|item|sku|total|page|serial|part|build|score|batch|lot"),
        re.match("[(]?[2-9][0-9]{2}[)]?[ .-][2-9]", m) is not None, re.match("(?!000|666|9)[0-9]{3}.(?!00)[0-9]{2}.(?!0000)", m) is not None, checked,
        list(pii.WIDE).index(kind) + 1, re.search("[0-9A-Za-z_/#$=-]$", b) is not None or re.match("[0-9A-Za-z_/=-]", a) is not None, re.match(r"([\s.,;)!?]|$)", a) is not None,
    ]


def plain_base(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or (k == "ip" and max(map(int, m[0].split("."))) < 256) or (k == "card" and 13 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data_whole_method(spark):
    """Candidates, features, scores, thresholds and choice, all recomputed in Python over documents and snippets."""
    trees, limits = pii.train(spark)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    made = [t for t, _ in pii._snippets(5)[:400]]
    r = random.Random(6)
    texts = docs + made + [" ".join(r.sample(made, 30)) for _ in range(10)] + ["+1 415-555-2671 415-555-2671 4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00 ok"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    wides = 0
    for row in pii.find_personal_data(df, model=(trees, limits)).collect():
        t = row["text"] or ""
        base = plain_base(t)
        found = []
        for k, p in FORMS.items():
            last = 0
            matches = list(p.finditer(t))
            for j, m in enumerate(matches):
                end = matches[j + 1].start() if j + 1 < len(matches) else len(t)
                f = [int(x) for x in plain_features(k, m[0], t[last : m.start()][-40:], t[m.end() : end][:8])]
                v = 0.0
                for tree in trees:
                    v += pii.score_of(tree, f)
                if v >= limits[k]:
                    found.append((-v, m.start(), m.end(), k))
                last = m.end()
        taken = [(s, e) for _, s, e in base]
        wide = []
        for _, s, e, k in sorted(found):
            if all(e <= a or b <= s for a, b in taken):
                taken.append((s, e))
                wide.append((k, s, e))
        wide.sort(key=lambda x: (list(pii.WIDE).index(x[0]), x[1]))
        assert [tuple(x) for x in row["spans"]] == base + wide, t[:200]
        wides += len(wide)
    assert wides > 100


def test_secrets_whole_method(spark):
    """Links by comparing every part with every other, over documents and made texts with many parts."""
    r = random.Random(8)
    token = lambda: "".join(r.choice("abcXYZ0123456789Qw") for _ in range(r.randint(18, 40)))
    bit = [lambda: f"user = {prose(r, 1)}", lambda: f"https://{prose(r, 1)}.example.com/" + "p" * r.choice([1, 1, 400]), token, lambda: f"AKIA{'Q7Z' * 6}", lambda: f"password: {token()}", lambda: prose(r, r.choice([3, 20, 60])), lambda: "\n\n", lambda: "0123456789abcdef" * 2]
    texts = [" ".join(r.choice(bit)() for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    linked = 0
    for t in texts:
        base = secrets.base_spans(t)
        ends = [(m.start(), m.end(), "endpoint") for m in secrets._ENDPOINT.finditer(t)]
        names = [(m.start(1), m.end(1), "identifier") for m in secrets._IDENTIFIER.finditer(t)]
        loose = [(m.start(), m.end(), "secret") for m in secrets._SECRET.finditer(t) if secrets._looks_secret(m[0]) and not any(s < m.end() and m.start() < e for s, e, _ in [*base, *ends, *names])]
        breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", t)]
        scope = lambda p: bisect.bisect_right(breaks, p[0])
        meet = lambda p, q: p != q and scope(p) == scope(q) and p[0] - secrets.REACH <= q[1] and q[0] <= p[1] + secrets.REACH
        ids = [*ends, *names, *(x for x in base if x[2] == "access")]
        held = [*loose, *(x for x in base if x[2] != "access")]
        want = [p for p in loose if any(meet(p, q) for q in ids)] + [p for p in [*ends, *names] if any(meet(p, q) for q in held)]
        got = secrets.spans_of(t)
        assert sorted(got) == sorted([*base, *want])
        linked += len(want)
    assert linked > 300


def spark_hash(values, seed=42):
    """Spark's xxhash64 of strings, ints (a one-element tuple) and longs, one after the other."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed & ((1 << 64) - 1))
        seed -= (seed >> 63) << 64
    return seed


def test_fingerprints_whole_method(spark):
    """The lexicon holds just the terms of the band, and fingerprints are those of plain Python."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + ["", "One one", "unseen"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    each = [[spark_hash([w]) for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for t in texts]
    df = collections.Counter(h for x in each for h in set(x))
    n = len(texts)
    want = {h for h, c in df.items() if fingerprints.BAND[0] * n <= c <= max(fingerprints.BAND[1] * n, 1)}
    lexicon = fingerprints.build_lexicon(docs)
    assert set(map(int, lexicon.terms.split(","))) == want
    got = {r["doc_id"]: r["sigs"] for r in fingerprints.with_fingerprint(docs, lexicon).collect()}
    for i, hashes in enumerate(each):
        own = sorted(set(hashes) & want)
        rank = {h: spark_hash([fingerprints.SEED, h] if fingerprints.SEED >= 1 << 31 else [(fingerprints.SEED,), h]) & ((1 << 64) - 1) for h in own}
        for k in range(fingerprints.SUBSETS):
            mine = [h for h in own if (rank[h] >> 3 * k) & 7 == 0]
            assert got[i][k] == spark_hash([(k,), spark_hash(mine or sorted(set(hashes)))]), (i, k)


def test_license_index_misses_nothing(spark):
    """Every template is found in noise, whole and with one word in twenty changed as long as it verifies; the stated bound holds."""
    import pyarrow as pa

    from brightvein.llm import _shingles

    m = licenses.Matcher(licenses.TEMPLATES, licenses.CONTAINED)
    assert (1 - m.least_likeness()) ** licenses.BANDS < 1e-6
    r = random.Random(13)
    for i, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for turn in range(6):
            w = text.split()
            for at in r.sample(range(len(w)), len(w) // 20 if turn % 2 else 0):
                w[at] = "changed"
            whole = f"{prose(r, r.randint(0, 90))} {' '.join(w)} {prose(r, 70)}"
            held = licenses.shingle_set([x for x, _, _ in licenses.tokens(" ".join(w))])
            for _, data, offsets in _shingles.steps(pa.array([whole])):
                seen = {t for t, _, _ in m.candidates(data, offsets).get(0, set())}
            if len(held & m.sets[i]) >= licenses.CONTAINED * len(m.sets[i]):
                assert i in seen, (name, turn)


def test_stages_hold_against_plain_python(spark, tmp_path):
    """Each stage's rows, from what the stage before it kept."""
    r = random.Random(6)
    words = "alpha beta gamma delta rho sigma tau phi chi psi omega kappa".split()
    own = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    texts = [own(r.randint(25, 90)) for _ in range(120)]
    texts += [texts[3], texts[3], " ".join([*texts[5].split()[:-1], "end"]), "short", "", None, own(40) + ' password = "aB3dE5fG7hI9kL" ' + own(5), "again and " * 40]
    rows = [(i + 1, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda out: sorted((tuple(x) for x in out.collect()), key=str)

    judged = {x["doc_id"]: x for x in quality.quality_rules(df, carry=["doc_id"]).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (judged[i]["n_words"], judged[i]["n_repeat_words"]) == (len(w), len(again))
        assert judged[i]["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    now = [x for x in rows if judged[x[0]]["kept"]]
    assert len(now) > 100
    out = corpus_pipeline.materialise(corpus_pipeline.quality_stage(spark, df, ""), "t")
    assert key(out) == sorted(now, key=str)

    least = {i: c for i, _, c in brute_components(now)}
    now = [x for x in now if least[x[0]] == x[0]]
    out = corpus_pipeline.materialise(corpus_pipeline.near_duplicate_stage(spark, out, ""), "t")
    assert key(out) == sorted(now, key=str)

    now = [(i, clean := secrets.redacted(t, secrets.spans_of(t), "[{}]"), lang, s, len(clean)) for i, t, lang, s, _ in now]
    assert any("[assign]" in x[1] for x in now)
    out = corpus_pipeline.materialise(corpus_pipeline.secret_stage(spark, out, ""), "t")
    assert key(out) == sorted(now, key=str)

    taken = {x["doc_id"]: x["copies"] for x in mixing.mix(out).collect()}
    now = [x for x in now for _ in range(taken[x[0]])]
    out = corpus_pipeline.materialise(corpus_pipeline.mixing_stage(spark, out, ""), "t")
    assert key(out) == sorted(now, key=str)

    pieces = corpus_pipeline.packing_stage(spark, out, "").collect()
    each = {i: [*encoder().tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t, *_ in now}
    want = collections.Counter(i for i, *_ in now)
    for p in pieces:
        ids = each[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(each[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == {i: n * len(each[i]) for i, n in want.items()}

    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in run.collect()) and run.count() > 0
    assert {p["doc_id"] for p in run.collect()} == set(want)
