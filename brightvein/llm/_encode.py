"""Token ids of whole texts by the tokenizers library, with the ids of repeated words remembered.

A byte-level tokenizer first cuts a text into words, each with the space before
it, and merges within these alone. So a text's ids are those of its units: it
is cut before every space, around a line feed between two visible characters,
and before a mark that ends a word. Units are bytes of the Arrow column; they
are hashed and looked up a column at a time in numpy, and only units not seen
before become strings and go through the tokenizer, many to a call.

Texts whose white space may be cut otherwise, or that hold a special token's
string, go through whole, and so do units of more than `LONGEST` bytes by
themselves. Units of up to seven bytes are told apart exactly, longer ones by
64-bit hashes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from ._shingles import hashes, steps

#: Units remembered at most; then those met only once since the last time are forgotten.
REMEMBER = 500_000
#: New units to a text that the tokenizer gets (it is slower on long ones), and texts to a call.
TOGETHER, TEXTS = 50, 80
LONGEST = 64
#: Bytes of text worked on at once, unless one text alone is longer.
STEP = 1 << 20
#: The first entry of an encoder's memory: the id that ends a text.
END = 0

_bytes = lambda *values: np.isin(np.arange(256), [v for x in values for v in (x if isinstance(x, range) else [x])])
_BLANK = _bytes(range(9, 14), range(28, 33))
#: Bytes that white space may end and begin with.
_BLANK_END, _BLANK_HEAD = _BLANK | _bytes(range(0x80, 0xC0)), _BLANK | _bytes(0xC2, 0xE1, 0xE2, 0xE3)
_LETTER = _bytes(range(65, 91), range(97, 123))
_MARK = _bytes(*b".,;:!?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table:
    """Numbers by 64-bit hash: open addressing, a column of keys at a time."""

    def __init__(self, room: int):
        self.mask = (1 << max(4, (2 * room).bit_length())) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those not there."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot = (slot[left] + 1 if len(slot) != len(left) else slot + 1) & self.mask
            held, want = self.keys[slot], keys[left]
            hit = held == want
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys, none of them there."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & self.mask


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """Ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str | None = None, end: int = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        cut, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        # texts are only cut into units where what is encoded together is known to end at blanks; any other tokenizer gets them whole
        self.cuts = self.tokenizer.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space and cut.use_regex and isinstance(model, models.BPE) and not model.dropout
        self.size = self.tokenizer.get_vocab_size()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.end = end
        self._forget()

    def _forget(self, stay: np.ndarray | None = None) -> None:
        """Start afresh with the entries `stay` and the end id."""
        old = (self.keys, self.at, self.long, self.pool) if stay is not None else None
        self.table = Table(REMEMBER)
        self.known, self.used = 0, 0
        self.keys = np.zeros(1 << 14, np.uint64)
        self.at, self.long, self.again = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)
        self.pool = np.zeros(1 << 16, np.uint32)
        self._add(np.zeros(1, np.uint64), np.array([self.end], np.uint32), np.ones(1, np.int64))
        if old is not None:
            keys, at, long, pool = old
            n = long[stay].astype(np.int64)
            ids = pool[np.repeat(at[stay] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            self._add(keys[stay], ids, n)

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = self.known, len(keys)
        self.pool = _grown(self.pool, self.used + len(ids))
        for name in ("keys", "at", "long", "again"):
            setattr(self, name, _grown(getattr(self, name), n + m))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.long[n : n + m], self.keys[n : n + m], self.again[n : n + m] = lengths, keys, False
        self.used += len(ids)
        self.known += m
        told = keys != 0
        self.table.add(keys[told], np.arange(n, n + m, dtype=np.int32)[told])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray) -> None:
        """Units not seen before, each once."""
        n = np.concatenate([[0], np.cumsum(length)])
        held = data[np.repeat(start - n[:-1], length) + np.arange(n[-1])]
        blank = np.concatenate([[0], np.cumsum(_BLANK[held] | (held >= 0x80))])
        spaced = held[n[:-1]] == 32
        inner = blank[n[1:]] - blank[n[:-1]] - spaced
        visible = (inner == 0) & (length > spaced)
        rest, done = [np.flatnonzero(~visible)], []
        for kind, mark in ((visible & spaced, None), (visible & ~spaced, self.line)):
            pick = np.flatnonzero(kind)
            if not len(pick) or (not spaced[pick[0]] and mark is None):
                rest.append(pick)
                continue
            size = length[pick] + (mark is not None)
            edge = np.concatenate([[0], np.cumsum(size)])
            joined = np.full(edge[-1], 10, np.uint8)
            m = length[pick]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            joined[np.repeat(edge[:-1], m) + within] = held[np.repeat(n[:-1][pick], m) + within]
            joined = joined.tobytes()
            for i in range(0, len(pick), TOGETHER * TEXTS):
                parts = [pick[j : j + TOGETHER] for j in range(i, min(i + TOGETHER * TEXTS, len(pick)), TOGETHER)]
                texts = [joined[edge[j] : edge[min(j + TOGETHER, len(pick))] - (mark is not None)].decode() for j in range(i, min(i + TOGETHER * TEXTS, len(pick)), TOGETHER)]
                got = self.whole(texts)
                for part, ids in zip(parts, got):
                    if mark is None:
                        first = np.flatnonzero(self.spaced[ids])
                        counts = np.diff(np.append(first, len(ids)))
                    else:
                        stops = np.flatnonzero(ids == mark)
                        counts = np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1
                        ids = np.delete(ids, stops)
                    if len(counts) != len(part):
                        rest.append(part)
                    else:
                        done.append((part, ids, counts))
        rest = np.concatenate(rest)
        held = held.tobytes()
        for i in range(0, len(rest), TEXTS):
            part = rest[i : i + TEXTS]
            got = self.whole([held[n[j] : n[j + 1]].decode() for j in part])
            done.append((part, np.concatenate(got), np.array(list(map(len, got)))))
        if done:
            part, ids, counts = map(np.concatenate, zip(*done))
            self._add(keys[part], ids, counts)

    def encode(self, texts: pa.Array | list[str], end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; with `end`, the end id after each text's."""
        outs = [(np.zeros(0, np.uint32), np.zeros(0, np.int64)), *(x for _, *x in self.stream(texts, end))]
        return tuple(map(np.concatenate, zip(*outs)))

    def stream(self, texts: pa.Array | list[str], end: bool = False):
        """What `encode` gives, a few texts after the other, each time with the first one's place."""
        if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = pa.array(texts, pa.large_string())
        for at, data, offsets in steps(texts, STEP):
            yield at, *self.encode_bytes(data, offsets, end)

    def _safe(self, data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray) -> np.ndarray:
        """Whether each text may be cut into units."""
        if not self.cuts:
            return np.zeros(len(offsets) - 1, bool)
        n = len(data)
        odd = np.zeros(len(offsets) - 1, bool)
        own = np.searchsorted(offsets, spaces, "right") - 1
        before = (spaces > offsets[own]) & _BLANK_END[data[spaces - 1]]
        last = spaces + 1 == offsets[own + 1]
        after = last | _BLANK_HEAD[data[np.minimum(spaces + 1, n - 1)]]
        odd[own[before & after]] = True
        raw = None
        for s in self.specials:
            raw = raw or data.tobytes()
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(s, at + 1)
        return ~odd

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if self.known > REMEMBER:
            self._forget(np.flatnonzero(self.again[: self.known]))
            if self.known > REMEMBER // 2:
                self._forget()
        n, texts = len(data), len(offsets) - 1
        if not n:
            return np.full(texts if end else 0, self.end, np.uint32), np.full(texts, int(end), np.int64)
        spaces = np.flatnonzero(data == 32)
        safe = self._safe(data, offsets, spaces)
        begins, edges = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        edges[offsets] = True
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = begins[spaces] = begins[n] = True
        lines = np.flatnonzero(data == 10)
        lines = lines[~edges[lines] & ~edges[lines + 1]]  # at a text's edge they stay with what is beside them
        lines = lines[~_BLANK_END[data[lines - 1]] & ~_BLANK_HEAD[data[lines + 1]]]
        begins[lines] = begins[lines + 1] = True
        marks = np.flatnonzero(_MARK[data])
        marks = marks[~edges[marks]]
        marks = marks[_LETTER[data[marks - 1]]]
        ended = edges | False
        ended[lines] = ended[spaces] = True
        begins[marks[ended[marks + 1]]] = True
        start = np.flatnonzero(begins)
        length = np.diff(start)
        start = start[:-1]
        owner_first = np.searchsorted(start, offsets)
        sizes = np.diff(owner_first)
        if not safe.all():
            fine = np.repeat(safe, sizes)
            start, length = start[fine], length[fine]
            sizes = np.where(safe, sizes, 0)
        keys = hashes(data, start, np.minimum(length, LONGEST + 1))  # those of longer ones aren't used
        index = self.table.find(keys)
        far = length > LONGEST
        index[far] = -1
        new = np.flatnonzero((index < 0) & ~far)
        self.again[index[index >= 0]] = True
        if len(new):
            own, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            self._learn(data, start[new[first]], length[new[first]], own)
            found = self.table.find(own)
            index[new] = found[back]
            self.again[found[np.bincount(back) > 1]] = True
        if far.any():
            at = np.flatnonzero(far)
            texts_of = [data[s : s + m].tobytes().decode() for s, m in zip(start[at].tolist(), length[at].tolist())]
            got = self.whole(texts_of)
            index[at] = np.arange(self.known, self.known + len(at))
            self._add(np.zeros(len(at), np.uint64), np.concatenate(got), np.array(list(map(len, got))))
        edge = np.concatenate([[0], np.cumsum(sizes)])
        if end:
            index = np.insert(index, edge[1:], END)
            edge = edge + np.arange(len(edge))
        long = self.long[index]
        total = np.concatenate([[0], np.cumsum(long, dtype=np.int64)])
        ids = self.pool[np.repeat(self.at[index] - total[:-1], long) + np.arange(total[-1])]
        counts = total[edge[1:]] - total[edge[:-1]]
        if not safe.all():
            where = np.flatnonzero(~safe).tolist()
            tail = np.full(int(end), self.end, np.uint32)
            odd = self.whole([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in where])
            own = {i: np.concatenate([x, tail]) for i, x in zip(where, odd)}
            at = total[edge]
            parts = [own[i] if i in own else ids[at[i] : at[i + 1]] for i in range(texts)]
            return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        return ids, counts


_made: dict[tuple[str | None, int], Encoder] = {}


def encoder(path: str | None = None, end: int = 0) -> Encoder:
    """One encoder a worker process, path and end id."""
    if (path, end) not in _made:
        _made[path, end] = Encoder(path, end)
    return _made[path, end]
