"""BM25 over a kept index that tells what it need not read.

Chunks are put in order where they lie and cut into ranges. A block holds the
postings of one term in one range and their greatest weight. Chunks of a range
are alike in length, so none holds more than a few terms, and what one can score
is at most the sum of that many of the greatest weights there. The terms that
promise most are scored first, and the k-th best of these sums is a bar. Terms
that together can't reach the bar are not searched: no chunk that has only such
terms is among the k best. The others' blocks are scored where their range can
reach the bar, and the rest of a query only for ranges with a chunk that may
still reach it. The blocks of a range meet in one task, whatever the number of
queries, and only chunks that reach the bar leave it. The result is that of
`retrieval.bm25`, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import analysed
from . import retrieval as R
from . import segments

#: Chunks of a range (a power of two), and the share of what a query's terms promise that is scored for the bar.
RANGE, FIRST = 64, 0.5
#: Queries that are scored at once.
TOGETHER = 256
#: What sums of weights in another order may differ by.
SLACK = 1e-6


def write_blocks(chunks: DataFrame, path: str, keys: list[str], order: list[str] | None = None, text_col: str = "text", buckets: int = 64, config: str = "simple", rows: int = RANGE) -> None:
    """`path`/blocks (`range`, `term`, `top`, `spots`, `tfs`; and for each range a row without term that has its `members`), in sorted runs, and `path`/terms with their idf, in `buckets` files.

    `order` are columns that the chunks of a task are sorted by before their
    lengths and keys: where alike ones lie together, fewer ranges reach the bar.
    Nothing but the terms' counts is shuffled.
    """
    if rows & (rows - 1):
        raise ValueError("rows must be a power of two")
    member = T.StructType([T.StructField("__spot", T.IntegerType()), T.StructField("__len", T.IntegerType()), *(chunks.schema[c] for c in keys)])
    numbers = T.ArrayType(T.IntegerType())
    shape = T.StructType([T.StructField("range", T.LongType()), T.StructField("term", T.StringType()), T.StructField("top", T.DoubleType()), T.StructField("spots", numbers), T.StructField("tfs", numbers), T.StructField("members", T.ArrayType(member))])
    own = chunks.sortWithinPartitions(*(order or []), F.length(text_col), *keys)
    # an id that counts up within a partition; partitions begin at multiples of 2 ** 33, so ranges never span two
    own = own.select(*keys, F.monotonically_increasing_id().alias("__id"), analysed(F.col(text_col), config).alias("ws"))
    segments.written(own.mapInArrow(_blocks(keys, rows), shape), f"{path}/blocks")
    blocks = chunks.sparkSession.read.parquet(f"{path}/blocks")
    n = float(blocks.filter("term IS NULL").agg(F.sum(F.size("members"))).first()[0] or 0)
    df = blocks.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("spots")).alias("df"), F.max("top").alias("top"))
    segments.written(df.withColumn("idf", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).repartition(buckets, "term").sortWithinPartitions("term"), f"{path}/terms")


def _weight(tf, length):
    """`retrieval.weight` with its default length, over arrays."""
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / R.AVGDL))


def _blocks(keys: list[str], rows: int):
    """The function that makes blocks and members of (keys, id, terms)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        edge = lambda first, n: pa.array(np.append(first, n).astype(np.int32))
        for columns, owner, _, terms in segments.stretches(batches, len(keys) + 1, lambda t: t.column(len(keys)).to_numpy() // rows):
            ids, size = columns[-1].to_numpy(), np.bincount(owner, minlength=len(columns[-1]))
            ranges, spots = ids // rows, (ids % rows).astype(np.int32)
            begin = segments.heads(ranges)
            member = pa.StructArray.from_arrays([pa.array(spots), pa.array(size.astype(np.int32)), *columns[:-1]], names=["__spot", "__len", *keys])
            none = lambda t: pa.nulls(len(begin), t)
            numbers = pa.list_(pa.int32())
            members = pa.ListArray.from_arrays(edge(begin, len(ids)), member)
            names = ["range", "term", "top", "spots", "tfs", "members"]
            yield pa.RecordBatch.from_arrays([pa.array(ranges[begin]), none(pa.string()), none(pa.float64()), none(numbers), none(numbers), members], names=names)
            if not len(owner):
                continue
            words, rank = segments.sorted_terms(terms)
            at = np.argsort(rank, kind="stable")  # owners, and so ranges, stay in order
            rank, owner = rank[at], owner[at]
            first = segments.heads(rank, owner)
            tf = np.diff(np.append(first, len(rank)))
            rank, owner = rank[first], owner[first]
            head = segments.heads(rank, ranges[owner])
            top = np.maximum.reduceat(_weight(tf, size[owner]), head)
            lists = [pa.ListArray.from_arrays(edge(head, len(owner)), pa.array(x.astype(np.int32))) for x in (spots[owner], tf)]
            made = pa.RecordBatch.from_arrays([pa.array(ranges[owner[head]]), words.take(pa.array(rank[head])), pa.array(top), *lists, pa.nulls(len(head), members.type)], names=names)
            for i in range(0, made.num_rows, 10_000):
                yield made.slice(i, 10_000)

    return work


class _Slice:
    """Some queries as matrices over the terms of all."""

    def __init__(self, asked: list, place: dict[str, int], bars: dict):
        import numpy as np

        self.ids = [i for i, _ in asked]
        width = max(len(ts) for _, ts in asked)
        shape = (len(asked), width)
        # no term: the last place, which has no weight
        self.at, self.idf, self.first, self.searched = np.full(shape, len(place)), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        self.bar = np.array([bars.get(i, 0.0) for i in self.ids])
        for q, (_, terms) in enumerate(asked):  # the greatest promise first
            left, rest = FIRST * sum(idf * top for _, idf, top in terms), np.cumsum([idf * top for _, idf, top in reversed(terms)])[::-1]
            for j, (term, idf, top) in enumerate(terms):
                self.at[q, j], self.idf[q, j] = place[term], idf
                self.first[q, j], left = left > 0, left - idf * top
                self.searched[q, j] = rest[j] >= self.bar[q]
        self.codes = np.unique(self.at)
        self.local = np.searchsorted(self.codes, self.at)

    def matrix(self, which):
        """Terms by queries: idf."""
        import numpy as np

        out = np.zeros((len(self.codes), len(self.ids)))
        q, j = np.nonzero(which & (self.idf > 0))
        out[self.local[q, j], q] = self.idf[q, j]
        return out


def _scorer(asked: list, bars: dict | None, k: int, width: int, counts: bool = False):
    """The function that scores ranges (`bs`, `ms`) against all queries: without bars the k best sums over the first terms, else the chunks that reach the bars; or how much of the blocks that takes."""

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = sorted({t for _, ts in asked for t, _, _ in ts})
        place, values = {t: i for i, t in enumerate(names)}, pa.array(names, pa.string())
        slices = [_Slice(asked[i : i + TOGETHER], place, bars or {}) for i in range(0, len(asked), TOGETHER)]
        matrices = [(s.matrix(s.first),) if bars is None else (s.matrix(s.searched), s.matrix(True)) for s in slices]
        held = [np.zeros((k, len(s.ids))) for s in slices]
        seen = [np.zeros((4, len(s.ids)), np.int64) for s in slices]
        for b in batches:
            found, taken = [], []
            for r in range(b.num_rows):
                bs, ms = b.column(0)[r].values, b.column(1)[r].values
                if bs is None or ms is None or not len(bs) or not len(ms):
                    continue
                term = pc.index_in(bs.field("term"), value_set=values).to_numpy()
                spots, tfs = bs.field("spots"), bs.field("tfs")
                n = pc.list_value_length(spots).to_numpy()
                member, lens = ms.field("__spot").to_numpy(), ms.field("__len").to_numpy()
                row = np.full(max(member.max(), pc.max(spots.flatten()).as_py()) + 1, -1)
                row[member] = np.arange(len(member))
                owner, code, tf = row[spots.flatten().to_numpy()], np.repeat(term, n), tfs.flatten().to_numpy()
                code, tf, owner = code[owner >= 0], tf[owner >= 0], owner[owner >= 0]
                weights = np.zeros((len(member), len(names) + 1))
                weights[owner, code] = _weight(tf, lens[owner])
                top, size = np.zeros(len(names) + 1), np.zeros(len(names) + 1, np.int64)
                top[term], size[term] = bs.field("top").to_numpy(), n
                most = max(int(lens.max()), 1)
                for i, s in enumerate(slices):
                    own = weights[:, s.codes]
                    if bars is None:
                        held[i] = np.partition(np.concatenate([held[i], own @ matrices[i][0]]), -k, axis=0)[-k:] if k else held[i]
                        continue
                    add = top[s.at] * s.idf
                    # no more terms than the longest chunk of the range has
                    reach = lambda x: -np.sort(-x, axis=1)[:, :most].sum(axis=1)
                    live = np.flatnonzero((reach(add) >= s.bar) & (add > 0).any(axis=1))
                    more = reach(np.where(s.searched, 0.0, add))
                    gains = own @ matrices[i][0][:, live]
                    may = (gains > 0) & (gains + more[live] >= s.bar[live])
                    if counts:
                        there, rest = add > 0, np.zeros(len(s.ids), bool)
                        is_live = rest.copy()
                        is_live[live], rest[live] = True, may.any(axis=0)
                        read = there & np.where(s.searched, is_live[:, None], rest[:, None])
                        ns = size[s.at]
                        seen[i] += np.stack([(ns * read).sum(axis=1), (ns * there).sum(axis=1), read.sum(axis=1), there.sum(axis=1)])
                        continue
                    live, may = live[may.any(axis=0)], may[:, may.any(axis=0)]
                    if not len(live):
                        continue
                    whole = np.round(np.where(may, own @ matrices[i][1][:, live], 0.0), 9)
                    held[i][:, live] = np.partition(np.concatenate([held[i][:, live], whole]), -k, axis=0)[-k:]
                    # what this task has found raises the bar of what leaves it
                    c, q = np.nonzero(may & (whole >= held[i][:, live].min(axis=0) - SLACK))
                    if len(c):
                        taken.append(pa.Table.from_arrays([pa.array([s.ids[x] for x in live[q]]), *(ms.field(2 + x).take(pa.array(c)) for x in range(width)), pa.array(whole[c, q])], names=[f"c{x}" for x in range(width + 2)]))
            if taken:
                yield from pa.concat_tables(taken).combine_chunks().to_batches()
        if bars is None:
            found = [(s.ids[q], x) for s, h in zip(slices, held) for q in range(len(s.ids)) for x in h[:, q] if x > 0]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found]), pa.array([x for _, x in found])], names=["query_id", "score"])
        elif counts:
            for s, x in zip(slices, seen):
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), *map(pa.array, x)], names=["query_id", *COUNTS])

    return work


COUNTS = ("postings_read", "postings_of_terms", "blocks_read", "blocks_of_terms")


class Blocks:
    """A kept index that is open; `cached` keeps it in memory."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, cached: bool = False):
        self.spark, self.buckets = spark, buckets
        self.blocks, self.terms = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms")
        if cached:
            self.blocks, self.terms = self.blocks.cache(), self.terms.cache()

    def _asked(self, queries: DataFrame, config: str) -> list[tuple]:
        """The stated queries' ids with their terms (term, idf, greatest weight), those that promise most first."""
        wanted = [(r["query_id"], r["term"]) for r in R.query_terms(queries, config).collect()]
        names = sorted({t for _, t in wanted})
        found = {r["term"]: (r["idf"], r["top"]) for r in self.terms.filter(segments.holds(names)).select("term", "idf", "top").collect()} if names else {}
        asked: dict = {}
        for i, t in wanted:
            if t in found:
                asked.setdefault(i, []).append((t, *found[t]))
        return [(i, sorted(terms, key=lambda x: (-x[1] * x[2], x[0]))) for i, terms in asked.items()]

    def _ranges(self, terms: set[str], where: Column | None) -> DataFrame:
        """Of each range the blocks of these terms, and its members, or those that `where` leaves."""
        heads = self.blocks.filter("term IS NULL").select("range", "members")
        if where is not None:
            rows = heads.select("range", F.explode("members").alias("m")).select("range", "m", "m.*").filter(where)
            heads = rows.groupBy("range").agg(F.collect_list("m").alias("members"))
        blocks = self.blocks.filter(segments.holds(sorted(terms))).select("range", F.struct("term", "top", "spots", "tfs").alias("b"))
        both = blocks.unionByName(heads, allowMissingColumns=True)
        return both.groupBy("range").agg(F.collect_list("b").alias("bs"), F.flatten(F.collect_list("members")).alias("ms")).select("bs", "ms")

    def _bars(self, asked: list, k: int, where: Column | None, kind: T.DataType) -> dict:
        """For each query a score that the k best reach: the k-th best sum over the terms that promise most."""
        first = set()
        for _, terms in asked:
            left = FIRST * sum(idf * top for _, idf, top in terms)
            for term, idf, top in terms:
                if left > 0:
                    first.add(term)
                left -= idf * top
        shape = T.StructType([T.StructField("query_id", kind), T.StructField("score", T.DoubleType())])
        sums = self._ranges(first, where).mapInArrow(_scorer(asked, None, k, 0), shape)
        return {r["query_id"]: r["score"] - SLACK for r in R.ranked(sums, ["query_id"], [F.desc("score")], k).filter(F.col("rank") == k).collect()}

    def search(self, queries: DataFrame, keys: list[str], k: int, where: Column | None = None, config: str = "simple") -> DataFrame:
        """`query_id`, `keys`, `score`, `rank`; ties by key. `queries` is a stated set; `where` is about keys and holds before the ranking. `keys` are those of `write_blocks`, in order."""
        asked, kind = self._asked(queries, config), queries.schema["query_id"].dataType
        members = self.blocks.schema["members"].dataType.elementType
        shape = T.StructType([T.StructField("query_id", kind), *(T.StructField(c, members[c].dataType) for c in keys), T.StructField("score", T.DoubleType())])
        if not asked:
            return R.ranked(self.spark.createDataFrame([], shape), ["query_id"], [F.desc("score"), *keys], k)
        bars = self._bars(asked, k, where, kind)
        found = self._ranges({t for _, ts in asked for t, _, _ in ts}, where).mapInArrow(_scorer(asked, bars, k, len(keys)), shape)
        return R.ranked(found, ["query_id"], [F.desc("score"), *keys], k)

    def blocks_read(self, queries: DataFrame, keys: list[str], k: int, config: str = "simple") -> DataFrame:
        """`query_id`, `postings_read`, `postings_of_terms`, `blocks_read`, `blocks_of_terms`: how much of its terms' postings a query scores once it has its bar."""
        asked, kind = self._asked(queries, config), queries.schema["query_id"].dataType
        shape = T.StructType([T.StructField("query_id", kind), *(T.StructField(c, T.LongType()) for c in COUNTS)])
        if not asked:
            return self.spark.createDataFrame([], shape)
        bars = self._bars(asked, k, None, kind)
        told = self._ranges({t for _, ts in asked for t, _, _ in ts}, None).mapInArrow(_scorer(asked, bars, k, len(keys), counts=True), shape)
        return told.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
