"""Lexical retrieval packing of documents into token sequences.

 1. One pass counts documents, words and document frequencies over the corpus.
    Frequencies of at least `RARE` of all documents are kept, which at most
    (mean distinct words a document) / RARE words have, whatever the corpus;
    rarer words all weigh as words of that frequency do.
 2. Each document gets a key, the three words that its weights and a seeded
    hash rank first, so documents with many telling words in common get like
    keys. Documents are dealt out in ranges of the key; a group of copies larger
    than a range is split by a row number.
 3. Each task cuts its range into shards of bounded size. A shard has a BM25
    inverted index over its documents' words, weighted by the corpus's
    statistics. A document fills whole sequences by itself; what is left of it
    seeds a window, and the index returns the unused remainders most like the
    seed, which greedily fill it. The remainder that meets the end of the window
    is cut there and keeps its rest for a later one. What is left at a shard's
    end is dealt to sequences whose lengths are powers of two, so nothing is padded.

Every id lies in exactly one piece. Memory is bounded by the shard (and the
longest document). Keys are written with the texts to the shared folder, so a
lost task is simply run again with the same result.

Defined results: null and empty texts are the end id alone; repeated rows are
packed one by one; null ids stay null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shingles
from ._encode import Table, encoder
from ._shared import discard, materialise, text_of

SEQUENCE = 1024
#: Ids a shard holds at most, unless one document alone has more.
SHARD_IDS = 2_000_000
K1, B = 1.2, 0.75
#: Share of documents below which words all weigh alike, and words known by frequency at most (RARE rises for texts of more different words).
RARE, KNOWN = 1 / 2000, 500_000
#: Words of a document's key.
KEY_WORDS = 3
SEED = np.uint64(0x51ED270B7F1A93C5)
#: Words in more than this share of a shard's documents have their weights as rows of a table, which add faster than postings.
COMMON = 0.1
#: Neighbours sorted at first; where a window takes more, so many times more are.
FIRST_NEIGHBOURS, MORE = 64, 8


#: Bits of a word's hash; the rest of a 64-bit number holds a document's place in a step or shard, so sorts are of plain numbers.
TERM_BITS, PLACE_BITS = 42, 22


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (1 or more) of all words (runs of letters, digits and bytes above ASCII; A-Z as a-z), and how many each text has."""
    _, _, found, first = _shingles.words(data, offsets, _shingles.ALNUM)
    return np.maximum(found >> np.uint64(64 - TERM_BITS), np.uint64(1)), np.diff(first)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def distinct(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of each document, by document: documents and terms."""
    keys = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(TERM_BITS), counts) | terms
    keys.sort()
    keys = keys[_runs(keys)]
    return (keys >> np.uint64(TERM_BITS)).astype(np.int64), keys & np.uint64((1 << TERM_BITS) - 1)


class Statistics:
    """Documents, their mean length in words, and the document frequencies of words; `known` holds (term, frequency)."""

    def __init__(self, docs: int, mean: float, known: list[tuple[int, int]], floor: float):
        self.docs, self.mean, self.floor = docs, mean, floor
        self.terms = np.array([t for t, _ in known], np.uint64)
        self.df = np.maximum(np.array([n for _, n in known], np.float64), floor)
        self._table = None

    def look_up(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The idf of each term, and whether its frequency is known."""
        if self._table is None:  # in each worker, once
            self._table = Table(max(len(self.terms), 1))
            self._table.add(self.terms, np.arange(len(self.terms), dtype=np.int32))
            df = np.append(self.df, self.floor)
            self._idf = np.log1p((self.docs - df + 0.5) / (df + 0.5))
        at = self._table.find(terms)
        return self._idf[at], at >= 0

    def __getstate__(self):
        return self.__dict__ | {"_table": None, "_idf": None}


def statistics(own: DataFrame) -> Statistics:
    """Counted over all of `own` (doc_id, text)."""

    def count(batches):
        docs = total = pairs = 0
        held, times = [], []
        waiting = 0

        def merged():
            t, n = np.concatenate(held), np.concatenate(times)
            order = np.argsort(t)
            t, n = t[order], n[order]
            head = _runs(t)
            return t[head], np.add.reduceat(n, head) if len(n) else n

        def rows(t, n):
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "n"])

        for b in _shingles.trimmed(batches):
            for _, data, offsets in _shingles.steps(b.column(0)):
                terms, counts = words(data, offsets)
                _, own_terms = distinct(terms, counts)
                own_terms.sort()
                head = _runs(own_terms)
                t, n = own_terms[head], np.diff(np.append(head, len(own_terms)))
                held.append(t)
                times.append(n)
                docs, total, pairs, waiting = docs + len(counts), total + len(terms), pairs + len(own_terms), waiting + len(t)
                if waiting > 2_000_000:
                    yield rows(*merged())
                    held, times, waiting = [], [], 0
        if held:
            yield rows(*merged())
        # 0 is no word's hash: three rows of totals, told apart by small counts' places
        yield rows(np.zeros(3, np.uint64), np.array([docs, total, pairs]) * 3 + np.arange(3))

    counted = own.select("text").mapInArrow(count, "term long, n long")
    counted = materialise(counted, "counted")
    totals = {r["k"]: r["n"] for r in counted.filter("term = 0").groupBy((F.col("n") % 3).alias("k")).agg(F.sum(F.expr("n DIV 3")).alias("n")).collect()}
    docs, total, pairs = totals.get(0, 0), totals.get(1, 0), totals.get(2, 0)
    share = max(RARE, pairs / max(docs, 1) / KNOWN)
    frequent = counted.filter("term <> 0").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.lit(max(share * docs, 2.0)))
    known = [(r["term"], r["n"]) for r in frequent.collect()]  # at most KNOWN rows
    discard(counted)
    return Statistics(docs, max(total / max(docs, 1), 1.0), known, max(share * docs, 1.0))


def keys_of(terms: np.ndarray, counts: np.ndarray, stats: Statistics) -> np.ndarray:
    """KEY_WORDS hashes for each document: its words by rank, the words with a known frequency first; 0 where it has fewer.

    A word's rank is an exponential variable with its squared idf as rate, from
    a hash of the word: the chance that two documents begin with the same word
    is their weighted likeness.
    """
    owner, terms = distinct(terms, counts)
    out = np.zeros((KEY_WORDS, len(counts)), np.int64)
    mixed = _shingles.mix(terms ^ SEED)
    chance = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    idf, known = stats.look_up(terms)
    rank = np.minimum(-np.log(chance) / np.maximum(idf, 1e-3) ** 2, 1e8) + np.where(known, 0.0, 1e9)
    head = _runs(owner)
    size = np.diff(np.append(head, len(owner)))
    for k in range(KEY_WORDS if len(owner) else 0):
        least = np.minimum.reduceat(rank, head)
        at = np.flatnonzero((rank == np.repeat(least, size)) & np.isfinite(rank))
        at = at[_runs(owner[at])]
        out[k, owner[at]] = mixed[at].view(np.int64)
        rank[at] = np.inf
    return out


class Index:
    """BM25 over the words of one shard: postings by term, as flat arrays.

    No word is left out but those of one document, which lead to no other. A
    common word's weights are a row of `table`, over all documents; with at most
    1 / COMMON times as many cells as there are postings, it is bounded as they are.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, stats: Statistics):
        docs = self.docs = len(counts)
        keys = np.repeat(np.arange(docs, dtype=np.uint64), counts) | terms << np.uint64(PLACE_BITS)
        if not len(keys):
            self.first_term = self.first_common = np.zeros(docs + 1, np.int64)
            return
        keys.sort()
        at = _runs(keys)
        tf = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        owner, terms = (keys & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32), keys >> np.uint64(PLACE_BITS)
        del keys, at
        head = _runs(terms)
        df = np.diff(np.append(head, len(terms)))
        weight = np.repeat(stats.look_up(terms[head])[0], df)
        del terms
        weight *= tf * (K1 + 1) / (tf + K1 * (1 - B + B * counts[owner] / stats.mean))
        del tf
        common = df > max(2, COMMON * docs)
        self.table = np.zeros((int(common.sum()), docs))
        self.owner, self.weight, term, self.terms_of, self.first_term = self._of(owner, weight, df, (df >= 2) & ~common)
        self.head = np.concatenate([[0], np.cumsum(df[(df >= 2) & ~common])])
        owner, weight, term, self.commons_of, self.first_common = self._of(owner, weight, df, common)
        self.table[term, owner] = weight

    def _of(self, owner: np.ndarray, weight: np.ndarray, df: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
        """The postings of the terms to `keep`, the terms numbered anew, and of each document the terms and where they begin."""
        chosen = np.repeat(keep, df)
        owner, df = owner[chosen], df[keep]
        term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=self.docs))])
        by_owner = owner.astype(np.int64) << 32 | term
        by_owner.sort()
        return owner, weight[chosen], term, by_owner.astype(np.int32), first  # the low half is the term

    def scores(self, doc: int) -> np.ndarray:
        """Of every document, the summed weights of the words it shares with `doc`."""
        score = np.zeros(self.docs)
        if self.first_term[-1]:
            terms = self.terms_of[self.first_term[doc] : self.first_term[doc + 1]]
            lo, n = self.head[terms], self.head[terms + 1] - self.head[terms]
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            score += np.bincount(self.owner[at], self.weight[at], self.docs)
        if self.first_common[-1]:
            for t in self.commons_of[self.first_common[doc] : self.first_common[doc + 1]]:
                score += self.table[t]
        return score

    def ranked(self, doc: int, free: np.ndarray) -> Iterator[int]:
        """Documents `free` at first, the most like `doc` first; ties by their place. They are sorted as far as they are taken."""
        score = self.scores(doc)
        hits = np.flatnonzero((score > 0) & free)
        score = -score[hits]
        size = FIRST_NEIGHBOURS
        while len(hits):
            if size < len(hits):
                now = score <= np.partition(score, size - 1)[size - 1]  # and all that tie with the last
            else:
                now = np.ones(len(hits), bool)
            yield from hits[now][np.argsort(score[now], kind="stable")]
            hits, score, size = hits[~now], score[~now], size * MORE


def pack_shard(edge: np.ndarray, index: Index, length: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start in it, length, sequence, offset); sequences count from 0."""
    sizes = np.diff(edge)
    pieces, sequence = [], 0
    start = sizes // length * length
    for d in np.flatnonzero(start):
        for s in range(0, int(start[d]), length):
            pieces.append((int(d), s, length, sequence, 0))
            sequence += 1
    free = start < sizes
    left = int((sizes - start).sum())
    seed, window = 0, 0
    while left:
        window = length if left >= length else 1 << (left.bit_length() - 1)
        while not free[seed]:
            seed += 1
        chosen, filled = seed, 0
        neighbours = None
        spare = seed
        while filled < window:
            take = int(min(window - filled, sizes[chosen] - start[chosen]))
            pieces.append((int(chosen), int(start[chosen]), take, sequence, filled))
            start[chosen] += take
            filled += take
            if start[chosen] == sizes[chosen]:
                free[chosen] = False
            if filled == window:
                break
            if neighbours is None:
                neighbours = index.ranked(seed, free)
            chosen = next((d for d in neighbours if free[d]), None)
            if chosen is None:
                while not free[spare]:
                    spare += 1
                chosen = spare
        left -= window
        sequence += 1
    return pieces


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64())])


def routed(own: DataFrame, stats: Statistics) -> DataFrame:
    """`own` (doc_id, text) with its keys `k0` to `k2` and a row number, as a written table."""
    held = own.sparkSession.sparkContext.broadcast(stats)

    def key(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 36
        for b in _shingles.trimmed(batches):
            for first, data, offsets in _shingles.steps(b.column(1)):
                keys = keys_of(*words(data, offsets), held.value)
                n = keys.shape[1]
                nth = pa.array(_shingles.mix(np.arange(at, at + n, dtype=np.uint64)).view(np.int64))
                at += n
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), *map(pa.array, keys), nth], names=["doc_id", "text", "k0", "k1", "k2", "nth"])

    return materialise(own.mapInArrow(key, "doc_id long, text string, k0 long, k1 long, k2 long, nth long"), "routed")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = 0, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row a piece: `doc_id`, `start`, `length`, `ids` (little-endian unsigned 32-bit), `doc_tokens`, `sequence_id`, `offset`, `sequence_length`."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    stats = statistics(own)
    keys = ["k0", "k1", "k2", "nth"]
    dealt = routed(own, stats).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    held = own.sparkSession.sparkContext.broadcast(stats)

    def rows(names: list, ids: np.ndarray, counts: np.ndarray, index: Index, first: int):
        """The batches of a shard's pieces, and how many sequences it has."""
        edge = np.concatenate([[0], np.cumsum(counts)])
        pieces = np.array(pack_shard(edge, index, length), np.int64)
        full = np.bincount(pieces[:, 3], pieces[:, 2]).astype(np.int64)
        for i in range(0, len(pieces), 2000):
            d, s, n, q, o = pieces[i : i + 2000].T
            at = np.repeat(edge[d] + s - np.cumsum(n) + n, n) + np.arange(n.sum())
            values = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer((np.concatenate([[0], np.cumsum(n)]) * 4).astype(np.int32)), pa.py_buffer(ids[at].astype("<u4", copy=False))])
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in d], pa.int64()), pa.array(s), pa.array(n), values, pa.array(counts[d]), pa.array(q + first), pa.array(o), pa.array(full[q])], schema=_SCHEMA), len(full)

    def pack(batches):
        from pyspark import TaskContext

        enc, first = encoder(tokenizer, end_id), TaskContext.get().partitionId() << 36
        names, held_ids, counts, terms, term_counts, total = [], [], [], [], [], 0

        def flush():
            nonlocal names, held_ids, counts, terms, term_counts, total, first
            index = Index(np.concatenate(terms), np.concatenate(term_counts), held.value)
            terms, term_counts = [], []
            ids, held_ids = np.concatenate(held_ids), []
            for batch, sequences in rows(names, ids, np.concatenate(counts), index, first):
                yield batch
            first += sequences
            names, counts, total = [], [], 0

        for b in _shingles.trimmed(batches):
            keys = b.column(0)
            for at, data, offsets in _shingles.steps(b.column(1)):
                ids, n = enc.encode_bytes(data, offsets, end=True)
                t, m = words(data, offsets)
                names += keys.slice(at, len(n)).to_pylist()
                for to, x in ((held_ids, ids), (counts, n), (terms, t), (term_counts, m)):
                    to.append(x)
                total += len(ids)
                if total >= shard_ids or len(names) >= 1 << (PLACE_BITS - 1):
                    yield from flush()
        if names:
            yield from flush()

    return dealt.mapInArrow(pack, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long")


def op5_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
