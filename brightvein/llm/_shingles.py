"""Words and word shingles of whole texts as 64-bit hashes, a column at a time in numpy.

Texts stay the bytes Arrow delivers them in; a word's hash is made from the
eight-byte numbers it consists of, so nothing is kept per byte of text.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, unless one text alone is longer.
STEP = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Slices of more bytes are hashed one by one.
LONG = 72

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: For words split at white space.
WORDS = ~_SPACES
#: For words of letters and digits; bytes above ASCII count as letters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def trimmed(batches):
    """The batches as they come; between them a worker's free memory goes back to the system."""
    trim = None
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        trim = ctypes.CDLL(None).malloc_trim
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start : start + length]; never 0. Slices of up to seven bytes have different ones."""
    if not len(start):
        return np.zeros(0, np.uint64)
    # the eight bytes from every place on, as one number each; only the bytes themselves are copied
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = eights[start] & _MASKS[np.minimum(length, 8)]
    out = mix(np.where(length < 8, out | (length.astype(np.uint64) << np.uint64(56)), mix(out + length.astype(np.uint64) * _A) ^ _B))
    far = np.flatnonzero(length > LONG)
    if len(far):
        import xxhash

        out[far] = [xxhash.xxh64_intdigest(data[s : s + n]) for s, n in zip(start[far].tolist(), length[far].tolist())]
    left, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(left):
        out[left] = mix(out[left] * _B ^ (eights[start[left] + at] & _MASKS[np.minimum(length[left] - at, 8)]))
        at += 8
        left = left[length[left] > at]
    return np.maximum(out, np.uint64(1))


def steps(column: pa.Array, step: int = STEP):
    """(first row, bytes, offsets) over runs of rows of about `step` bytes; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, their hashes (A-Z as a-z), and each text's first word (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, hashes(_LOWER[data], start, end - start), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and each text's first; a text of 1 to k - 1 words is one shingle."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], np.uint64)
    whole = count >= k
    if whole.any():
        every = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for j in range(k):
            every += hashes[j : len(hashes) - k + 1 + j] * _MULTIPLIERS[j]
        pick = np.repeat(first[:-1][whole] - np.cumsum(n[whole]) + n[whole], n[whole]) + np.arange(n[whole].sum())
        out[np.repeat(at[:-1][whole], n[whole]) + np.arange(n[whole].sum()) - np.repeat(np.cumsum(n[whole]) - n[whole], n[whole])] = every[pick]
    for c in range(1, k):
        few = np.flatnonzero(count == c)
        if len(few):
            h = np.full(len(few), c, np.uint64) * _MULTIPLIERS[15]
            for j in range(c):
                h += hashes[first[few] + j] * _MULTIPLIERS[j]
            out[at[few]] = h
    return mix(out), at
