"""A kept vector index: rows in lists by their nearest centroid, read list by list.

Centroids are fitted on a bounded sample (the `SAMPLE` rows of least hash, at
most); every row is then put into the list of its nearest one and written with
its payload columns. A query reads the lists of its `probes` nearest centroids
alone, a payload filter is pushed to the scan, and what is read is scored
exactly, so only a row in another list can be missed. Rows of another length
than the centroids lie in list -1, which queries of such lengths read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import keep, kept
from . import retrieval as R

#: Rows at most that centroids are fitted on, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 8, 4096
#: Lists that a query reads: so many at least, and this share of all. Vectors without clusters need a share as large; those with clusters do with far less.
PROBES, SHARE = 8, 0.6


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit rows by cosine: each round a row goes to its nearest, and a list without rows takes the one that fits worst."""
    rows = _unit(sample)
    centroids = rows[:: max(1, len(rows) // lists)][:lists].copy()
    for _ in range(rounds):
        score = rows @ centroids.T
        own = score.argmax(1)
        worst = np.argsort(score.max(1), kind="stable")
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = rows[worst[: len(empty)]]
        centroids = _unit(sums)
    return centroids


def _vectors(df: DataFrame, key: str, embedding: str, payload: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.transform(embedding, lambda x: x.cast("float")).alias("v"), *payload).filter("key IS NOT NULL AND v IS NOT NULL")


def write_vectors(vectors: DataFrame, path: str, key: str, payload: list[str] | None = None, lists: int | None = None, embedding: str = "embedding") -> None:
    """`path`/centroids and `path`/rows, the latter partitioned by list and, within a list, over as many files as it needs."""
    spark, payload = vectors.sparkSession, payload or []
    own = _vectors(vectors, key, embedding, payload)
    n = own.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    picked = [r["v"] for r in own.select("v", F.xxhash64("key").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    size = max({len(v) for v in picked}, key=[len(v) for v in picked].count, default=0)
    centroids = fitted(np.array([v for v in picked if len(v) == size], float).reshape(-1, size), lists) if size else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            lengths = np.diff(b.column(1).offsets.to_numpy())
            flat, edge = b.column(1).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            found, rows = np.full(len(lengths), -1, np.int32), np.flatnonzero((lengths == size) & (size > 0))
            if len(rows):
                found[rows] = (_unit(flat[edge[rows][:, None] + np.arange(size)].astype(float)) @ centroids.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], names=[*b.schema.names, "list"])

    placed = own.mapInArrow(assign, T.StructType([*own.schema.fields, T.StructField("list", T.IntegerType())]))
    # ranges of (list, hash): a list of many rows is cut into several files, small ones share a task
    keep(placed.repartitionByRange("list", F.xxhash64("key")), f"{path}/rows", "list")


class Vectors:
    """A kept index that is open; `cached` keeps its rows in memory."""

    def __init__(self, spark: SparkSession, path: str, cached: bool = False):
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in found])
        self.rows = kept(spark, f"{path}/rows")
        if cached:
            self.rows = self.rows.cache()

    def lists_of(self, query: list, probes: int | None) -> list[int]:
        """The lists a query reads, the nearest first."""
        n = len(self.centroids)
        if not n or len(query) != self.centroids.shape[1]:
            return [-1]
        near = np.argsort(-(self.centroids @ _unit(np.array([query], float))[0]), kind="stable")
        return near[: probes or max(PROBES, round(n * SHARE))].tolist()

    def search(self, queries: DataFrame, key: str, k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """`query_id`, `key`, `score`, `rank`: the `k` nearest of each query among the rows of its lists that meet `where`; ties by key.

        `queries` (`query_id`, `embedding`) is a stated set. All lists are read
        with `probes` of as many or more, and the result is then exact.
        """
        asked = [r for r in queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")).collect() if r["q"] is not None]
        by: dict[int, list[int]] = {}
        for i, r in enumerate(asked):
            for x in self.lists_of(r["q"], probes):
                by.setdefault(x, []).append(i)
        rows = self.rows.filter(F.col("list").isin(list(by))) if by else self.rows.limit(0)
        rows = (rows if where is None else rows.filter(where)).select("list", "key", "v")
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, score double"
        out = rows.mapInArrow(_nearest([r["query_id"] for r in asked], [r["q"] for r in asked], by, k), schema)
        return R.ranked(out.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), "key"], k).withColumnRenamed("key", key)


def _nearest(ids: list, queries: list, by: dict[int, list[int]], k: int):
    """The function that scores rows against the queries that read their list; the k best of each leave the task."""
    units = [_unit(np.array([q], float))[0] for q in queries]

    def work(batches):
        import pyarrow as pa

        held: dict[int, tuple] = {}
        for b in batches:
            lists, keys = b.column(0).to_numpy(), b.column(1)
            lengths = np.diff(b.column(2).offsets.to_numpy())
            flat, edge = b.column(2).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
            for x in np.unique(lists).tolist():
                for size in {len(units[i]) for i in by[x]}:
                    mine = [i for i in by[x] if len(units[i]) == size]
                    rows = np.flatnonzero((lists == x) & (lengths == size))
                    if not len(rows) or not size:
                        continue
                    scores = np.round(np.array([units[i] for i in mine]) @ _unit(flat[edge[rows][:, None] + np.arange(size)].astype(float)).T, 9)
                    own = np.array(keys.take(pa.array(rows)).to_pylist(), object if not pa.types.is_integer(keys.type) else np.int64)
                    for i, score in zip(mine, scores):
                        a, s = held.get(i, (own[:0], score[:0]))
                        a, s = np.concatenate([a, own]), np.concatenate([s, score])
                        top = np.lexsort((a, -s))[:k]
                        held[i] = (a[top], s[top])
        for i, (a, s) in held.items():
            yield pa.RecordBatch.from_pydict({"query_id": [ids[i]] * len(a), "key": a.tolist(), "score": s})

    return work


def recall(found: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """`query_id`, `found`, `wanted`: how many of a query's true hits were found."""
    both = true.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
