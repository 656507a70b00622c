"""JPEG intra frames in numpy: sequential DCT frames are decoded, lossless ones are decoded and written.

All frames with equal headers are decoded together: each frame, or each restart
interval of one, is a lane with a bit position of its own, and a step takes the
next symbol of every lane. What one frame would cost in single symbols is thus
shared by hundreds.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

#: Order of a block's coefficients, and the Huffman tables of frames that bring none (counts by code length, then symbols).
ZIGZAG = np.array([x for s in range(15) for x in sorted((8 * i + s - i for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0)])
_DC = list(range(12))
_LUMA = [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A]
_CHROMA = [0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1]
_ALL = [16 * run + size for run in range(16) for size in range(1, 11)]
DEFAULTS = {
    (0, 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], _DC),
    (0, 1): ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], _DC),
    (1, 0): ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], _LUMA + [x for x in _ALL if x not in _LUMA]),
    (1, 1): ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], _CHROMA + [x for x in _ALL if x not in _CHROMA]),
}
#: Lanes decoded at once.
LANES = 4096


class Unreadable(ValueError):
    """A frame that is damaged or of a kind that is not read."""


@dataclass(frozen=True)
class Header:
    """What a frame's segments up to its scan say."""

    lossless: bool
    width: int
    height: int
    parts: tuple  # (horizontal, vertical, quantiser, DC table, AC table) of each component, in the scan's order
    quantisers: dict
    tables: dict
    restart: int
    predictor: int
    shift: int
    size: int  # bytes up to the scan's data


def read_header(frame: bytes) -> Header:
    if frame[:2] != b"\xff\xd8":
        raise Unreadable("no start of image")
    at, quantisers, tables, restart, shape = 2, {}, dict(DEFAULTS), 0, None
    try:
        while True:
            while frame[at + 1] == 0xFF:
                at += 1
            if frame[at] != 0xFF:
                raise Unreadable("no marker where one should be")
            kind, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
            body, at = frame[at + 4 : at + 2 + size], at + 2 + size
            if size < 2 or len(body) != size - 2:
                raise Unreadable("a segment that ends early")
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide, name = body[i] >> 4, body[i] & 15
                    quantisers[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                    i += 129 if wide else 65
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    counts = list(body[i + 1 : i + 17])
                    tables[body[i] >> 4, body[i] & 15] = (counts, list(body[i + 17 : i + 17 + sum(counts)]))
                    i += 17 + sum(counts)
            elif kind == 0xDD:
                restart = struct.unpack(">H", body[:2])[0]
            elif kind in (0xC0, 0xC1, 0xC3):
                precision, height, width, n = struct.unpack(">BHHB", body[:6])
                if precision != 8 or not height or not width:
                    raise Unreadable("not 8-bit samples, or no size")
                shape = (kind == 0xC3, width, height, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)})
            elif 0xC0 <= kind <= 0xCF and kind != 0xCC:
                raise Unreadable("neither sequential Huffman nor lossless")
            elif kind == 0xDA:
                if shape is None or body[0] != len(shape[3]):
                    raise Unreadable("a scan without its frame, or not of all components")
                parts = tuple((*shape[3][body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
                if shape[0] and any(p[:2] != (1, 1) for p in parts) and len(parts) > 1:
                    raise Unreadable("lossless with subsampling")
                if not shape[0] and not all(p[2] in quantisers for p in parts) or not all(1 <= x <= 4 for p in parts for x in p[:2]):
                    raise Unreadable("a component without its quantiser or size")
                return Header(*shape[:3], parts, quantisers, tables, restart, body[-3], body[-1] & 15, at)
    except (IndexError, KeyError, ValueError, struct.error) as e:
        raise Unreadable(str(e)) from e


def lookup(counts: list, symbols: list) -> np.ndarray:
    """By the next 16 bits: 256 times the code's length plus its symbol; 0 where no code begins so."""
    out, code = np.zeros(1 << 16, np.int64), 0
    rest = iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            if lo >= 1 << 16:
                raise Unreadable("more codes than bits")
            out[lo : lo + (1 << (16 - length))] = 256 * length + next(rest)
            code += 1
        code <<= 1
    return out


class _Lanes:
    """Bit positions in the data of many scans, and the reading of a symbol and the bits after it in each."""

    def __init__(self, scans: list[bytes]):
        raw = b"".join(x + bytes(8) for x in scans) + bytes(16)
        self.words = np.ndarray((len(raw) - 8,), ">u8", raw, strides=(1,))
        size = np.array([len(x) for x in scans])
        start = np.concatenate([[0], np.cumsum(size + 8)[:-1]])
        self.at, self.end = start * 8, (start + size) * 8
        self.bad = np.zeros(len(scans), bool)

    def window(self, lanes) -> np.ndarray:
        p = np.minimum(self.at[lanes], self.end[lanes])
        return self.words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(self, lanes, window: np.ndarray, entry: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed number of `size` bits after a code; moves on."""
        length = entry >> 8
        bits = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        self.at[lanes] += length + size
        self.bad[lanes] |= (entry == 0) | (self.at[lanes] > self.end[lanes])
        return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _scans(header: Header, frames: list[bytes]) -> tuple[list[bytes], int]:
    """The scans' data without stuffing, cut at restarts: as many pieces for each frame."""
    out, h, v = [], max(p[0] for p in header.parts), max(p[1] for p in header.parts)
    edge = (1, 1) if header.lossless else (8 * h, 8 * v) if len(header.parts) > 1 else (8, 8)
    units = -(-header.width // edge[0]) * -(-header.height // edge[1])
    pieces = -(-units // header.restart) if header.restart else 1
    for frame in frames:
        data = frame[header.size :]
        stop = re.search(rb"\xff+[^\x00\xff\xd0-\xd7]", data)
        found = re.split(rb"\xff+[\xd0-\xd7]", data[: stop.start()] if stop else data) if header.restart else [data[: stop.start()] if stop else data]
        found = (found + [b""] * pieces)[:pieces]
        out += [x.replace(b"\xff\x00", b"\xff") for x in found]
    return out, pieces


def _lossless(header: Header, lanes: _Lanes, n: int, pieces: int) -> list[np.ndarray]:
    w, parts = header.width, len(header.parts)
    if header.restart % w:
        raise Unreadable("restarts within a line")
    rows = header.restart // w if header.restart else header.height
    tables = [lookup(*header.tables[0, p[3]]) for p in header.parts]
    diff, every = np.zeros((parts, rows * w, n * pieces), np.int32), slice(None)
    last = header.height - rows * (pieces - 1)
    ends = np.tile(np.where(np.arange(pieces) == pieces - 1, last * w, rows * w), n)
    for i in range(rows * w):
        live = every if i < last * w else np.flatnonzero(i < ends)
        for c in range(parts):
            x = lanes.window(live)
            entry = tables[c][(x >> np.uint64(48)).astype(np.int64)]
            size = np.minimum(entry & 255, 16)
            if (size == 16).any():  # stands for 32768 and has no bits after it
                far = size == 16
                got = lanes.take(live, x, entry, np.where(far, 0, size))
                diff[c, i, live] = np.where(far, 32768, got)
            else:
                diff[c, i, live] = lanes.take(live, x, entry, size)
    first = 1 << (7 - header.shift)
    out = []
    for c in range(parts):
        d = np.ascontiguousarray(diff[c].T).reshape(-1, rows, w)
        if header.predictor == 1:
            d[:, 0, 0] += first
            d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
            x = np.cumsum(d, axis=2)
        else:
            x = _predicted(d, header.predictor, first)
        out.append(((x.reshape(n, pieces * rows, w)[:, : header.height] & 0xFFFF) << header.shift).astype(np.uint8))
    return out


def _predicted(d: np.ndarray, kind: int, first: int) -> np.ndarray:
    x = np.zeros_like(d)
    for r in range(d.shape[1]):
        for c in range(d.shape[2]):
            if r and c:
                a, b, o = x[:, r, c - 1], x[:, r - 1, c], x[:, r - 1, c - 1]
                guess = {2: b, 3: o, 4: a + b - o, 5: a + ((b - o) >> 1), 6: b + ((a - o) >> 1), 7: (a + b) >> 1}.get(kind)
                if guess is None:
                    raise Unreadable("an unknown predictor")
            else:
                guess = x[:, r, c - 1] if c else x[:, r - 1, c] if r else first
            x[:, r, c] = (guess + d[:, r, c]) & 0xFFFF
    return x


_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _sequential(header: Header, lanes: _Lanes, n: int, pieces: int) -> list[np.ndarray]:
    parts = header.parts if len(header.parts) > 1 else tuple((1, 1, *p[2:]) for p in header.parts)
    h, v = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-header.width // (8 * h)), -(-header.height // (8 * v))
    owner = np.array([c for c, p in enumerate(parts) for _ in range(p[0] * p[1])])
    names = sorted({(0, p[3]) for p in parts} | {(1, p[4]) for p in parts})
    tables = np.concatenate([lookup(*header.tables[k]) for k in names])
    dc, ac = (np.array([names.index((k, p[3 + k])) for p in parts]) << 16 for k in (0, 1))
    units = header.restart or across * down
    count = np.tile(np.where(np.arange(pieces) == pieces - 1, across * down - units * (pieces - 1), units), n) * len(owner)
    out = np.zeros((n * pieces, units * len(owner), 64), np.int32)
    block, k = np.zeros(n * pieces, np.int64), np.zeros(n * pieces, np.int64)
    live = np.arange(n * pieces)
    while len(live):
        at, part = k[live], owner[block[live] % len(owner)]
        x = lanes.window(live)
        entry = tables[np.where(at == 0, dc[part], ac[part]) + (x >> np.uint64(48)).astype(np.int64)]
        symbol = entry & 255
        size = np.where(at == 0, np.minimum(symbol, 15), symbol & 15)
        value = lanes.take(live, x, entry, size)
        at = at + np.where(at == 0, 0, symbol >> 4)
        lanes.bad[live] |= at > 63
        out[live, block[live], np.minimum(at, 63)] = np.where(size > 0, value, 0)
        over = (k[live] > 0) & (size == 0) & (symbol != 0xF0)  # the rest of the block is 0
        at = np.where(over | lanes.bad[live], 64, at + 1)
        block[live] += at > 63
        k[live] = np.where(at > 63, 0, at)
        live = live[(block[live] < count[live]) & ~lanes.bad[live]]
    planes = []
    for c, p in enumerate(parts):
        mine = out[:, np.flatnonzero(np.tile(owner, units) == c)].copy()
        mine[:, :, 0] = np.cumsum(mine[:, :, 0], axis=1)
        square = np.zeros(mine.shape, float)
        square[:, :, ZIGZAG] = mine * header.quantisers[p[2]]
        pixels = np.clip(np.rint(_COSINES.T @ square.reshape(-1, 8, 8) @ _COSINES) + 128, 0, 255).astype(np.uint8)
        pixels = pixels.reshape(n, pieces * units, p[1], p[0], 8, 8)[:, : across * down].reshape(n, down, across, p[1], p[0], 8, 8)
        plane = pixels.transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, down * p[1] * 8, across * p[0] * 8)
        planes.append(plane[:, : -(-header.height * p[1] // v), : -(-header.width * p[0] // h)])
    return planes


def decode(frames: list[bytes]) -> list[list[np.ndarray] | None]:
    """The component planes of each frame, luminance first; null for one that can't be read."""
    out: list = [None] * len(frames)
    known: dict[bytes, Header | None] = {}
    groups: dict[bytes, list[int]] = {}
    for i, f in enumerate(frames):
        head = f[: f.find(b"\xff\xda") + 2 + 12]  # the scan's own header is at most so long
        if head not in known:
            try:
                known[head] = read_header(f)
            except Unreadable:
                known[head] = None
        if known[head] is not None:
            groups.setdefault(f[: known[head].size], []).append(i)
    for head, members in groups.items():
        header = known.get(head) or read_header(head)
        area = header.width * header.height * (1 if header.lossless else 4) // 1024 + 1
        some = max(1, LANES // area)
        for a in range(0, len(members), some):
            mine = members[a : a + some]
            try:
                scans, pieces = _scans(header, [frames[i] for i in mine])
                lanes = _Lanes(scans)
                planes = (_lossless if header.lossless else _sequential)(header, lanes, len(mine), pieces)
            except (Unreadable, KeyError, IndexError, StopIteration):
                continue
            bad = lanes.bad.reshape(len(mine), pieces).any(axis=1)
            for j, i in enumerate(mine):
                out[i] = None if bad[j] else [p[j] for p in planes]
    return out


#: The written frames' Huffman table: a code of 9 - s bits for differences of s bits, so that each takes 9.
_COUNTS, _SYMBOLS = [1] * 9 + [0] * 7, list(range(8, -1, -1))
_d = np.arange(-255, 256)
_s = np.array([int(abs(x)).bit_length() for x in _d])
#: By difference + 255: the 9 bits, a code of ones and a zero and then the number (below 0 less one).
_BITS = ((((1 << (8 - _s)) - 1) << 1 << _s) | (np.where(_d < 0, _d - 1, _d) & ((1 << _s) - 1))).astype(np.uint16)
WIDTH = 64


def write_header(rows: int) -> bytes:
    """The segments before the scan's data of a lossless frame of `rows` lines."""
    shape = struct.pack(">HHBHHBBBB", 0xFFC3, 11, 8, rows, WIDTH, 1, 1, 0x11, 0)
    table = struct.pack(">HHB", 0xFFC4, 19 + len(_SYMBOLS), 0) + bytes(_COUNTS) + bytes(_SYMBOLS)
    return b"\xff\xd8" + shape + table + struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, 1, 0, 1, 0, 0)


def encode(lines: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The scan data, 72 bytes a line and not yet stuffed, of lines of `WIDTH` samples; `first` marks each frame's first line."""
    x = lines.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[:, 0] = x[:, 0] - np.where(first, 128, np.concatenate([[128], x[:-1, 0]]))
    v = _BITS[d + 255].reshape(-1, 8)
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = ((v[:, j - 1] << (8 - j)) | (v[:, j] >> (j + 1))) & 255
    out[:, 8] = v[:, 7] & 255
    return out.reshape(-1, WIDTH // 8 * 9)
