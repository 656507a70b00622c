"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    tied = down.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return tied.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """`node`, `label` (the least node of its component) for every node of `links` (a, b) and of `before`, an earlier result.

    Every step is a written table; none gathers a component in one task, and
    the number of steps grows with the logarithm of the longest path. With
    `before`, the links join its components to larger ones.
    """
    links = links.filter("a <> b").select("a", "b")
    if before is not None:
        links = links.unionByName(before.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    now = materialise(links, "edges")
    state = None
    while True:
        had, state = state, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == had or not state[0]:
            break
        new = materialise(_small_star(_large_star(now)), "edges")
        discard(now)
        now = new
    roots = now.select(F.col("b").alias("node")).distinct()
    out = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label"))).distinct(), "labels")
    discard(now)
    return out
