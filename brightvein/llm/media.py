"""Media columns: AVI motion-JPEG, read into timed clips, and texts stored as such files.

A file's RIFF chunks are walked, its index is parsed (the OpenDML index where
there is one, else `idx1`, else the chunks of `movi` themselves), its frames are
decoded (`jpeg`), and the brightness histograms of neighbouring frames are
compared. A shot begins where the difference stands out from those around it by
`SIGMAS` standard deviations, is the greatest near by, and is above `FLOOR`; all
of that is integer arithmetic. One row a clip with its times is the result.

Texts are stored losslessly: their bytes, padded to lines of 64, are the 8-bit
samples of lossless frames, 16 lines each; a chunk `plen` tells the payload's
length.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal
files; null media and bytes that are no such file have no frames and no clips; a
frame that can't be decoded counts as `bad` and is left out of the comparison, an
empty one repeats the frame before; an empty table gives an empty result; extra
columns pass through (one called like an output gives way to it). Each row is
worked on by itself, so a lost task is simply run again.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from ._shingles import steps, trimmed

WIDTH, LINES, RATE = jpeg.WIDTH, 16, 25
#: Bytes of texts or media worked on at once, unless one alone is longer.
STEP = 2 << 20
#: A cut: so many standard deviations above the differences within REACH, the greatest within NEAR, and this share of all pixels.
SIGMAS, REACH, NEAR, FLOOR = 3, 8, 2, (1, 5)
BINS = 32

_KEYFRAME = 0x10


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, payload: int | None = None, rate: int = RATE) -> bytes:
    """A motion-JPEG file of `frames` with its `idx1` index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    lists = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    own = _chunk(b"plen", struct.pack("<Q", payload)) if payload is not None else b""
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", _KEYFRAME, at, len(f)))
        at += 8 + len(f) + len(f) % 2
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + lists + own + movi + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    """What a file's chunks tell: its picture's size, the seconds a frame as a fraction, and where its frames lie."""

    width: int = 0
    height: int = 0
    scale: int = 1
    rate: int = RATE
    payload: int | None = None
    frames: list[tuple[int, int]] = field(default_factory=list)


def _chunks(data: bytes, at: int, end: int):
    """(name, start, end) of the chunks in data[at:end]; one that says it is longer ends there."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Avi | None:
    """The first video stream of a file; null for bytes that are no such file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    out, stream, video, open_dml, movi, idx1 = Avi(), -1, None, [], [], None
    after = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    lists = [(12, after)]
    for name, a, b in _chunks(data, after + after % 2, len(data)):  # further RIFF parts of a long file
        if name == b"RIFF":
            lists.append((a + 4, b))
    while lists:
        at, end = lists.pop(0)
        for name, a, b in _chunks(data, at, end):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi.append((a, b))
            elif name == b"LIST":
                if data[a : a + 4] == b"strl":
                    stream += 1
                    kinds = {n: (x, y) for n, x, y in _chunks(data, a + 4, b)}
                    x, y = kinds.get(b"strh", (0, 0))
                    if video is None and y - x >= 32 and data[x : x + 4] == b"vids":
                        video = stream
                        scale, rate = struct.unpack_from("<II", data, x + 20)
                        out.scale, out.rate = (scale, rate) if scale and rate else (out.scale, out.rate)
                        x, y = kinds.get(b"strf", (0, 0))
                        if y - x >= 12:
                            out.width, out.height = struct.unpack_from("<ii", data, x + 4)
                        if b"indx" in kinds:
                            open_dml.append(kinds[b"indx"])
                else:
                    lists.insert(0, (a + 4, b))
            elif name == b"avih" and b - a >= 4 and struct.unpack_from("<I", data, a)[0]:
                out.scale, out.rate = struct.unpack_from("<I", data, a)[0], 1_000_000
            elif name == b"plen" and b - a == 8:
                out.payload = struct.unpack_from("<Q", data, a)[0]
            elif name == b"idx1":
                idx1 = (a, b)
    names = {b"%02ddc" % (video or 0), b"%02ddb" % (video or 0)}
    out.frames = _open_dml(data, open_dml) or _idx1(data, idx1, movi, names) or _walked(data, movi, names)
    return out


def _open_dml(data: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Frames by the OpenDML index: standard indexes, or a super index that lists them."""
    frames = []
    for a, b in found:
        if b - a < 24:
            return []
        kind, n = data[a + 3], struct.unpack_from("<I", data, a + 4)[0]
        if kind == 0:
            spots = [struct.unpack_from("<QI", data, a + 24 + 16 * i) for i in range(min(n, (b - a - 24) // 16))]
            for at, size in spots:
                if at + 32 > len(data) or data[at : at + 2] != b"ix":
                    return []
                frames += _open_dml(data, [(at + 8, min(at + size, len(data)))])
        elif kind == 1:
            base = struct.unpack_from("<Q", data, a + 12)[0]
            for i in range(min(n, (b - a - 24) // 8)):
                at, size = struct.unpack_from("<II", data, a + 24 + 8 * i)
                frames.append((base + at, base + at + (size & 0x7FFFFFFF)))
    return frames if all(b <= len(data) for _, b in frames) else []


def _idx1(data: bytes, found: tuple[int, int] | None, movi: list, names: set[bytes]) -> list[tuple[int, int]]:
    """Frames by `idx1`, whose places count from `movi` or from the file's start; nothing if they don't fit the data."""
    if found is None or not movi:
        return []
    rows = [struct.unpack_from("<4sIII", data, at) for at in range(found[0], found[1] - 15, 16)]
    rows = [r for r in rows if r[0] in names]
    for base in (movi[0][0], 0):
        if rows and all(data[base + at : base + at + 4] == name and base + at + 8 + size <= len(data) for name, _, at, size in rows):
            return [(base + at + 8, base + at + 8 + size) for _, _, at, size in rows]
    return []


def _walked(data: bytes, movi: list, names: set[bytes]) -> list[tuple[int, int]]:
    frames, left = [], [(a + 4, b) for a, b in movi]
    while left:
        at, end = left.pop(0)
        here = []
        for name, a, b in _chunks(data, at, end):
            if name in names:
                frames.append((a, b))
            elif name == b"LIST" and data[a : a + 4] == b"rec ":
                here.append((a + 4, b))
        left = here + left
    return sorted(frames)


def store(payload: bytes) -> bytes:
    """A payload of whole lines as a lossless motion-JPEG file."""
    total = len(payload) // WIDTH
    lines = min(LINES, total)
    head, frames = jpeg.write_header(lines), []
    chunk = lines * max(1, (1 << 20) // (lines * WIDTH))  # lines coded at once
    for a in range(0, total, chunk):
        part = np.frombuffer(payload, np.uint8, min(chunk, total - a) * WIDTH, a * WIDTH).reshape(-1, WIDTH)
        over = len(part) % lines
        if over:  # the last frame repeats its own lines, so that its brightness stays what it is
            part = np.concatenate([part, np.resize(part[-over:], (lines - over, WIDTH))])
        scans = jpeg.encode(part, np.arange(len(part)) % lines == 0).reshape(len(part) // lines, -1)
        frames += [head + s.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for s in scans]
    return write_avi(frames, WIDTH, lines, len(payload))


def histogram(plane: np.ndarray) -> np.ndarray:
    return np.bincount((plane >> 3).ravel(), minlength=BINS)


def cuts(difference: list[int], pixels: list[int]) -> list[int]:
    """Places in the sequence of differences at which a shot begins."""
    out = []
    d = np.array(difference, np.int64)
    for i, own in enumerate(difference):
        near = d[max(i - NEAR, 0) : i + NEAR + 1]
        if own * FLOOR[1] < 2 * pixels[i] * FLOOR[0] or own < near.max() or (d[max(i - NEAR, 0) : i] == own).any():
            continue
        around = [int(x) for x in np.concatenate([d[max(i - REACH, 0) : i], d[i + 1 : i + 1 + REACH]])]
        n, s, squares = len(around), sum(around), sum(x * x for x in around)
        above = n * own - s
        if not n or above > 0 and above * above > SIGMAS * SIGMAS * (n * squares - s * s):
            out.append(i)
    return out


_CLIP = [("clip", pa.int64()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("cut", pa.int64())]
_VIDEO = pa.struct([("width", pa.int64()), ("height", pa.int64()), ("frames", pa.int64()), ("bad", pa.int64()), ("clips", pa.list_(pa.struct(_CLIP))), ("payload", pa.binary())])
_VIDEO_SQL = "struct<width: bigint, height: bigint, frames: bigint, bad: bigint, clips: array<struct<clip: bigint, first_frame: bigint, frames: bigint, start_us: bigint, end_us: bigint, cut: bigint>>, payload: binary>"


def _watched(avi: Avi | None, planes: list) -> dict | None:
    """A file's clips, and the samples of its frames where they hold a payload."""
    if avi is None:
        return None
    for i, (a, b) in enumerate(avi.frames):
        if a == b and i:
            planes[i] = planes[i - 1]
    seen = [(i, p[0]) for i, p in enumerate(planes) if p is not None]
    told = [histogram(p) for _, p in seen]
    pairs = [(int(np.abs(x - y).sum()), min(p.size, q.size)) for x, y, (_, p), (_, q) in zip(told, told[1:], seen, seen[1:])]
    at = cuts([d for d, _ in pairs], [p for _, p in pairs])
    firsts = ([0] if avi.frames else []) + [seen[i + 1][0] for i in at]
    time = lambda i: i * 1_000_000 * avi.scale // avi.rate
    clips = [{"clip": k, "first_frame": a, "frames": b - a, "start_us": time(a), "end_us": time(b), "cut": pairs[at[k - 1]][0] if k else 0} for k, (a, b) in enumerate(zip(firsts, [*firsts[1:], len(avi.frames)]))]
    whole = avi.payload is not None and len(seen) == len(planes)
    payload = b"".join(p.tobytes() for _, p in seen)[: avi.payload] if whole else None
    return {"width": avi.width, "height": avi.height, "frames": len(planes), "bad": len(planes) - len(seen), "clips": clips, "payload": payload}


def watch(files: list[bytes | None]) -> list[dict | None]:
    """What `watched` says of each file; the frames of all are decoded together."""
    avis = [None if x is None else read_avi(x) for x in files]
    planes = jpeg.decode([x[a:b] for x, avi in zip(files, avis) if avi for a, b in avi.frames])
    out, at = [], 0
    for avi in avis:
        n = len(avi.frames) if avi else 0
        out.append(_watched(avi, planes[at : at + n]))
        at += n
    return out


def _others(df: DataFrame, out: str, used: str) -> tuple[DataFrame, int]:
    if out.lower() == used.lower():
        raise ValueError("the output is the input column")
    keep = [c for c in df.columns if c.lower() != out.lower()]
    return df.select(*(F.col(f"`{c}`") for c in keep)), [c.lower() for c in keep].index(used.lower())


def stored(docs: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """`docs` with `out`, each whole text as a lossless motion-JPEG file."""
    docs, at = _others(docs, out, text_col)

    def work(batches):
        for b in trimmed(batches):
            for row, data, offsets in steps(b.column(at), STEP):
                raw = data.tobytes()
                files = []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    files.append(store(raw[s:e] + bytes(-(e - s) % WIDTH if e > s else WIDTH)))
                rows = b.slice(row, len(files))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(files, pa.binary())], names=[*b.schema.names, out])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def watched(media: DataFrame, media_col: str = "media", out: str = "video") -> DataFrame:
    """`media` with `out`: size, number of frames, frames that are `bad`, `clips`, and the `payload` of a file that `stored` made."""
    media, at = _others(media, out, media_col)
    kind = T.StructType([*media.schema.fields, *media.sparkSession.createDataFrame([], f"`{out}` {_VIDEO_SQL}").schema.fields])

    def work(batches):
        for b in trimmed(batches):
            column = b.column(at)
            size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], np.int64)
            edge, row = np.concatenate([[0], np.cumsum(size)]), 0
            while row < len(size):
                to = max(row + 1, int(np.searchsorted(edge, edge[row] + STEP, "right")) - 1)
                seen = watch(column.slice(row, to - row).to_pylist())
                rows = b.slice(row, to - row)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(seen, _VIDEO)], names=[*b.schema.names, out])
                row = to

    return media.mapInArrow(work, kind)


def clips(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row a clip: the other columns of `media`, `clip` (from 0), its first frame and number of frames, its times in microseconds, and the difference at its `cut`."""
    seen = watched(media, media_col, "__video")
    names = [n for n, _ in _CLIP]
    keep = [c for c in seen.columns if c.lower() not in ("__video", media_col.lower(), *names)]
    return seen.select(*(F.col(f"`{c}`") for c in keep), F.explode("__video.clips").alias("__clip")).select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"__clip.{n}").alias(n) for n in names))


def op11_motion_jpeg(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = stored(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    seen = watched(made)
    told = F.array_join(F.transform("video.clips", lambda c: F.concat_ws(":", c["start_us"], c["end_us"], c["cut"])), ",")
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("video.payload").cast("long").alias("payload_bytes"), F.sha2("video.payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(video.payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", F.concat_ws("x", "video.width", "video.height"), "video.frames", told).alias("feature"),
    )
