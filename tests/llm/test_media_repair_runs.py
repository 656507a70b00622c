"""Motion-JPEG files, conversation repair and periodic runs, each against a plain version of its own."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

from brightvein.llm import jpeg, media, periodic, repair

from test_llm import WORD, docs, folder, nothing, prose, rows  # noqa: F401  (fixtures)
from test_whole import CLASH

# ---- motion JPEG


def plain_codes(counts, symbols):
    out, code, rest = {}, 0, iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[next(rest)] = (length, code)
            code += 1
        code <<= 1
    return out


class Bits:
    def __init__(self):
        self.bits = []

    def add(self, length, value):
        self.bits += [value >> i & 1 for i in range(length - 1, -1, -1)]

    def number(self, v, size):
        self.add(size, v if v >= 0 else v + (1 << size) - 1)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(sum(b << (7 - i) for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def plain_dct(block):
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    return [[0.25 * c(u) * c(v) * sum((block[y][x] - 128) * math.cos((2 * x + 1) * v * math.pi / 16) * math.cos((2 * y + 1) * u * math.pi / 16) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]


def plain_frame(planes, sampling, width, height, step=2, restart=0, tables=True):
    """A sequential frame written by single symbols, and the planes a decoder must make of it."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    order = [(u, s - u) if s % 2 else (s - u, u) for s in range(15) for u in range(s + 1) if u < 8 and s - u < 8]
    codes = {k: plain_codes(*t) for k, t in jpeg.DEFAULTS.items()}
    made = [np.zeros((-(-height // (8 * v)) * s[1] * 8, -(-width // (8 * h)) * s[0] * 8)) for s in sampling]
    out, bits, last, units = b"", Bits(), [0] * len(planes), 0
    for my in range(-(-height // (8 * v))):
        for mx in range(-(-width // (8 * h))):
            if restart and units and units % restart == 0:
                out += bits.data() + bytes([0xFF, 0xD0 + (units // restart - 1) % 8])
                bits, last = Bits(), [0] * len(planes)
            units += 1
            for c, (sh, sv) in enumerate(sampling):
                for by in range(sv):
                    for bx in range(sh):
                        y, x = (my * sv + by) * 8, (mx * sh + bx) * 8
                        p = planes[c]
                        block = [[int(p[min(y + j, len(p) - 1)][min(x + i, len(p[0]) - 1)]) for i in range(8)] for j in range(8)]
                        f = plain_dct(block)
                        q = [round(f[a][b] / step) for a, b in order]
                        size = abs(q[0] - last[c]).bit_length()
                        bits.add(*codes[0, min(c, 1)][size])
                        bits.number(q[0] - last[c], size)
                        last[c], run = q[0], 0
                        for k in range(1, 64):
                            if q[k] == 0:
                                run += 1
                                continue
                            while run > 15:
                                bits.add(*codes[1, min(c, 1)][0xF0])
                                run -= 16
                            size = abs(q[k]).bit_length()
                            bits.add(*codes[1, min(c, 1)][16 * run + size])
                            bits.number(q[k], size)
                            run = 0
                        if run:
                            bits.add(*codes[1, min(c, 1)][0])
                        grid = np.zeros((8, 8))
                        for (a, b), value in zip(order, q):
                            grid[a, b] = value * step
                        cu = [math.sqrt(0.5)] + [1] * 7
                        for j in range(8):
                            for i in range(8):
                                made[c][y + j, x + i] = 128 + 0.25 * sum(cu[a] * cu[b] * grid[a, b] * math.cos((2 * i + 1) * b * math.pi / 16) * math.cos((2 * j + 1) * a * math.pi / 16) for a in range(8) for b in range(8) if grid[a, b])
    out += bits.data()
    head = b"\xff\xd8" + struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([step] * 64)
    head += struct.pack(">HHBHHB", 0xFFC0, 8 + 3 * len(planes), 8, height, width, len(planes)) + b"".join(bytes([i + 1, s[0] << 4 | s[1], 0]) for i, s in enumerate(sampling))
    if tables:
        for (kind, name), (counts, symbols) in jpeg.DEFAULTS.items():
            head += struct.pack(">HHB", 0xFFC4, 19 + len(symbols), kind << 4 | name) + bytes(counts) + bytes(symbols)
    if restart:
        head += struct.pack(">HHH", 0xFFDD, 4, restart)
    head += struct.pack(">HHB", 0xFFDA, 6 + 2 * len(planes), len(planes)) + b"".join(bytes([i + 1, min(i, 1) * 17]) for i in range(len(planes))) + bytes([0, 63, 0])
    want = [np.clip(np.rint(m), 0, 255)[: -(-height * s[1] // v), : -(-width * s[0] // h)] for m, s in zip(made, sampling)]
    return head + out + b"\xff\xd9", want


@pytest.mark.parametrize(("sampling", "restart", "tables"), [(((1, 1),), 0, True), (((1, 1),), 2, False), (((2, 2), (1, 1), (1, 1)), 0, False), (((2, 1), (1, 1), (1, 1)), 1, True)])
def test_sequential_frames(sampling, restart, tables):
    r = np.random.default_rng(len(sampling) + restart)
    width, height = 37, 21
    frames, wants = [], []
    for _ in range(3):
        h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
        planes = [r.integers(0, 256, (-(-height * s[1] // v), -(-width * s[0] // h))) if i else np.add.outer(np.arange(height) * 5, np.arange(width) * 2) % 256 for i, s in enumerate(sampling)]
        frame, want = plain_frame(planes, sampling, width, height, restart=restart, tables=tables)
        frames.append(frame)
        wants.append(want)
    damaged = frames[0][:-40]
    got = jpeg.decode([*frames, damaged, b"", b"\xff\xd8 no", frames[0][:100]])
    assert got[3:] == [None] * 4
    for g, w in zip(got, wants):
        assert [x.shape for x in g] == [x.shape for x in w]
        assert all(np.abs(x.astype(int) - y).max() <= 1 for x, y in zip(g, w))


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames(predictor):
    """Single symbols and every predictor, by the definition."""
    r = np.random.default_rng(predictor)
    image = r.integers(0, 256, (9, 64))
    codes, bits = plain_codes([1] * 9, range(8, -1, -1)), Bits()
    for y in range(9):
        for x in range(64):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            guess = (128 if not x else a) if not y else b if not x else {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[predictor]
            d = int(image[y, x]) - guess
            if abs(d) > 255:
                image[y, x] = d = max(0, min(255, guess))
                d = int(image[y, x]) - guess
            size = abs(d).bit_length()
            bits.add(*codes[size])
            bits.number(d, size)
    head = bytearray(jpeg.write_header(9))
    head[-3] = predictor
    got = jpeg.decode([bytes(head) + bits.data() + b"\xff\xd9"])[0][0]
    assert (got == image).all()


def flat(shade, noise, r):
    return np.clip(np.full((media.LINES, media.WIDTH), shade) + r.integers(-noise, noise + 1, (media.LINES, media.WIDTH)), 0, 255).astype(np.uint8)


def frame_of(plane):
    first = np.arange(len(plane)) == 0
    return jpeg.write_header(len(plane)) + jpeg.encode(plane, first).tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_shots_and_indexes():
    r = np.random.default_rng(3)
    shades = [40] * 12 + [200] * 20 + [90] * 9
    frames = [frame_of(flat(s, 9, r)) for s in shades]
    whole = media.write_avi(frames, 64, 16)
    empty = media.write_avi([*frames[:5], b"", *frames[5:]], 64, 16)
    walked = whole[: whole.index(b"idx1")]
    broken = frames.copy()
    broken[3] = frames[3][:90]
    movi = whole.index(b"movi")
    spots, at = [], movi + 4
    for f in frames:
        spots.append((at + 8, len(f)))
        at += 8 + len(f) + len(f) % 2
    ix = struct.pack("<HBBI4sQI", 2, 0, 1, len(spots), b"00dc", 0, 0) + b"".join(struct.pack("<II", a + 24 + 8 + 16, n) for a, n in spots)
    strf = whole.index(b"strf")
    indx = b"indx" + struct.pack("<I", 40) + struct.pack("<HBBI4s3I", 4, 0, 0, 1, b"00dc", 0, 0, 0) + struct.pack("<QII", 0, 8 + len(ix), len(frames))
    cut = strf + 48
    dml = bytearray(whole[:cut] + indx + walked[cut:])
    place = len(dml)
    struct.pack_into("<Q", dml, cut + 32, place)
    dml += b"ix00" + struct.pack("<I", len(ix)) + ix
    struct.pack_into("<I", dml, 4, len(dml) - 8)
    for name in (b"hdrl", b"strl"):  # the lists that hold the new chunk grow
        i = dml.index(name) - 4
        struct.pack_into("<I", dml, i, struct.unpack_from("<I", dml, i)[0] + 48)
    seen = media.watch([whole, empty, walked, bytes(dml), media.write_avi(broken, 64, 16), None, b"", b"RIFFxxxxAVI ", whole[:700]])
    assert media.read_avi(bytes(dml)).frames == [(a + 48, a + 48 + n) for a, n in spots]
    want = [(0, 12, 0, 480_000), (12, 20, 480_000, 1_280_000), (32, 9, 1_280_000, 1_640_000)]
    for s in (seen[0], seen[2], seen[3], seen[4]):
        assert [(c["first_frame"], c["frames"], c["start_us"], c["end_us"]) for c in s["clips"]] == want
    assert [c["first_frame"] for c in seen[1]["clips"]] == [0, 13, 33]
    assert seen[4]["bad"] == 1 and seen[0]["bad"] == 0 and seen[5:7] == [None, None]
    assert seen[7]["frames"] == 0 and seen[7]["clips"] == [] and seen[8]["frames"] >= seen[8]["bad"]


def brute_cuts(d, pixels):
    out = []
    for i, x in enumerate(d):
        near, around = d[max(i - 2, 0) : i + 3], d[max(i - 8, 0) : i] + d[i + 1 : i + 9]
        if x / (2 * pixels[i]) < 0.2 or x < max(near) or x in d[max(i - 2, 0) : i]:
            continue
        mean = sum(around) / len(around) if around else 0
        if not around or x > mean and (x - mean) ** 2 > 9 * sum((y - mean) ** 2 for y in around) / len(around) + 1e-9:
            out.append(i)
    return out


def test_cuts():
    r = random.Random(6)
    for _ in range(300):
        d = [r.choice([0, 3, 10, 50, 400, 900, 2000]) for _ in range(r.randint(0, 30))]
        assert media.cuts(d, [1024] * len(d)) == brute_cuts(d, [1024] * len(d))


def test_texts_as_media(docs, nothing, rows, folder, spark):
    got = media.op11_motion_jpeg(spark, folder).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        for r in by[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
            file = media.store(full)
            assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert media.watched(media.stored(nothing)).collect() == []
    found = media.clips(media.stored(docs)).collect()
    assert {r["spans"] for r in found} == {"x"} and all(r["start_us"] < r["end_us"] for r in found)
    odd = spark.createDataFrame([(1, None), (2, b"none")], "id long, media binary")
    assert [(r["video"]) for r in media.watched(odd).collect()] == [None, None] and media.clips(odd).count() == 0


def test_long_text_as_media(spark):
    r = random.Random(8)
    part = prose(r, 4000)
    text = "é" + part * (5 * (1 << 20) // len(part))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in media.watched(media.stored(df)).select("doc_id", "video.payload", "video.bad").collect()}
    assert got[1]["payload"].rstrip(b"\0").decode() == text == got[3]["payload"].rstrip(b"\0").decode() and got[2]["payload"].rstrip(b"\0") == b"short"


# ---- conversation repair


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def plain_repair(rows, ids):
    """Every state's cheapest and then least edits, prefix by prefix, with whole strings."""
    after = lambda q, i: {"u": 2 if q in (0, 1, 3) else None, "a": 3 if q == 2 else None, "s": 1 if q == 0 else None}.get(i)

    def put(layer, q, x):
        if q is not None and (q not in layer or x[:2] < layer[q][:2]):
            layer[q] = x

    def inserted(layer):
        for _ in range(3):
            for q, (cost, audit, kept) in list(layer.items()):
                for name in ("user", "assistant"):
                    put(layer, after(q, name[0]), (cost + 5, audit + "I", [*kept, name + ":"]))
        return layer

    out = {}
    for c in ids:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults, layer = set(), [], inserted({0: (0, "", [])})
        for _, _, role, text in mine:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not chars else "again" if (role, text) in seen else "cut" if chars[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            new, more = {}, 5 * (fault == "cut")
            for q, (cost, audit, kept) in layer.items():
                put(new, q, (cost + 2, audit + "D", kept))
                if fault in ("", "cut"):
                    put(new, after(q, role[:1]), (cost + more, audit + "K", [*kept, f"{role}:{text}"]))
                    for name in ("user", "assistant"):
                        put(new, after(q, name[0]), (cost + more + 1, audit + "R", [*kept, f"{name}:{text}"]))
            layer = inserted(new)
        cost, audit, kept = min((layer[q] for q in (0, 3) if q in layer), key=lambda x: x[:2])
        turns = [r[1] for r in mine if r[1] is not None]
        roles = [r[2][:1] for r in mine]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (c, gaps, *(faults.count(f) for f in ("blank", "again", "cut")), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()), kept
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(12)
    texts = [None, "", "  ", "hi.", "hello there", "ok!\n", "why?", "é.", "x.y "]
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(9)]), r.choice([None, "user", "assistant", "user", "assistant", "system", "tool", "", "a", "Uu"]), r.choice(texts)) for _ in range(900)]
    rows += [(777, i // 2, r.choice(["user", "assistant", "system"]), f"text {r.randrange(400)}" + r.choice(["", ".", "!"])) for i in range(700)]
    return rows + [(778, None, "user", "the same.")] * 300 + [(779, 1, "user", "cut off")]


def test_repair(spark, talk, tmp_path, monkeypatch):
    """Also in blocks of few rows, over which costs, frontier and digest go on."""
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS costs", "'x' AS digest").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain_repair(plain_damage(talk), {r[0] for r in talk})
    for rows in (40, repair.ROWS):
        monkeypatch.setattr(repair, "ROWS", rows)
        got = {r[0]: tuple(r) for r in repair.op12_structure_repair(spark, str(tmp_path)).collect()}
        assert got == {c: row for c, (row, _) in want.items()}
    assert any(len(row[7]) > 600 for row, _ in want.values())


def test_repaired_turns(spark, talk):
    rows = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in talk]
    got = {}
    for r in repair.repaired_turns(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect():
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    want = plain_repair(rows, {r[0] for r in rows})
    assert got == {c: kept for c, (_, kept) in want.items() if kept}


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none).collect() == [] == repair.repaired_turns(none).collect()
    asked = spark.createDataFrame([(5,), (5,)], "conv_id long")
    assert [tuple(r) for r in repair.repair(none, asked).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# ---- periodic runs


def brute_runs(w, least=4, shortest=6):
    out = {}
    for q in range(1, len(w) // least + 1):
        i = 0
        while i < len(w) - q:
            if w[i] == w[i + q]:
                s = i
                while i < len(w) - q and w[i] == w[i + q]:
                    i += 1
                if i - s + q >= max(shortest, least * q):
                    out.setdefault((s, i - s + q), q)
            else:
                i += 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda x: (x[0], x[2]))


def periodic_words(r, n, kinds):
    w = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 8 else 0):
        a, p = r.randrange(n), r.randint(1, 12)
        for i in range(a, a + r.randint(1, n - a)):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_of():
    r = random.Random(2)
    for _ in range(600):
        w = periodic_words(r, r.randint(0, 90), r.choice([1, 2, 3, 9]))
        h = np.array(w, np.uint64)
        for least, shortest in ((4, 6), (2, 4), (3, 1)):
            assert [tuple(x) for x in periodic.runs_of(h, least=least, shortest=shortest).tolist()] == brute_runs(w, least, shortest)


def plain_op13(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p, old = 1 + (n - a) // (3 + g % 8), list(w)
        w = old[:a] + [old[a + (i - a) % p] for i in range(a, n)]
    runs, gone = brute_runs(w), set()
    for s, length, q in runs:
        gone |= set(range(s + q, s + length))
    best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def looped():
    r = random.Random(9)
    names = ["an", "The", "the", "é", "interminable-word", "x" * 90]
    texts = [None, "", " \n", "one"] + [r.choice([" ", "\n", "\x0b "]).join(names[k] for k in periodic_words(r, r.randint(1, 300), 6)) for _ in range(120)]
    return [(None if i % 41 == 40 else i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[8]), (500, "go on\n" * 4000), (501, "a " * 9000)]


def test_periodic_runs(spark, looped, tmp_path):
    spark.createDataFrame(looped, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((plain_op13(*x) for x in looped if x[0] not in (500, 501)), key=str)
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted((r for r in got if r[0] not in (500, 501)), key=str) == want and len(got) == len(looped)
    assert {r[0]: r[1:6] for r in got if r[0] in (500, 501)} == {500: (1, 0, 8000, 2, 4_000_000), 501: (1, 0, 9000, 1, 9_000_000)}


def test_lags_dealt_out(spark, looped):
    """Texts above the bound, whose lags are dealt out, get the runs that others get; any column stays."""
    df = spark.createDataFrame([(*x, *["KEEP"] * len(CLASH)) for x in looped], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).withColumnsRenamed({"th": "t", "cid": "lo"})
    apart, at_once = (sorted(map(str, periodic.periodic_runs(df, long=n).collect())) for n in (60, periodic.LONG))
    assert apart == at_once and "KEEP" in apart[0]
    assert periodic.periodic_runs(df.limit(0)).collect() == []
