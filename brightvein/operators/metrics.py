"""How well ranked lists find what is judged relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis
from .retrieval import sized_broadcast

#: Words that a passage and a text that holds it are joined by, before the whole passage is looked for.
ANCHOR = 5


def planted(passages: DataFrame, texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`query_id`, `key`: the texts that hold a passage (`query_id`, `text`) as it stands.

    Passages meet the windows of as many words as their beginnings have, up to
    `ANCHOR`; only these pairs are compared.
    """
    asked = passages.select("query_id", F.col("text").alias("passage"), analysis.words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    asked = asked.withColumn("n", F.least(F.size("ws"), F.lit(ANCHOR))).withColumn("anchor", F.array_join(F.slice("ws", F.lit(1), F.col("n")), " "))
    lengths = sorted(r["n"] for r in asked.select("n").distinct().collect())
    own = texts.select(F.col(key).alias("key"), F.col(text_col).alias("__text"), analysis.words(F.col(text_col)).alias("ws"))
    windows = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))).otherwise(F.array().cast("array<string>"))
    anchors = F.array_distinct(F.flatten(F.array(*(windows(n) for n in lengths)))) if lengths else F.array().cast("array<string>")
    pairs = own.select("key", "__text", F.explode(anchors).alias("anchor")).join(sized_broadcast(asked.select("query_id", "passage", "anchor"), 100_000), "anchor")
    return pairs.filter(F.contains("__text", F.col("passage"))).select("query_id", F.col("key").alias(key)).distinct()


def measured(lists: DataFrame, relevant: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """For each judged query (and list of `by`): `relevant`, `recall`, `reciprocal_rank` and `ndcg` of its `k` first.

    `lists` has `query_id`, `key`, `rank`, from 1, and `relevant` `query_id` and
    `key`. A query that nothing relevant was found for counts with zeros.
    """
    by = by or []
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    names = lists.select(*by).distinct() if by else None
    hits = lists.filter(F.col("rank") <= k).join(relevant.select("query_id", key), ["query_id", key])
    own = hits.groupBy("query_id", *by).agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    # every judged query with every list: the lists are a handful of names
    asked = wanted if names is None else wanted.select("*", F.explode(F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in r.asDict().items())) for r in names.limit(1_000).collect()))).alias("__l")).select("query_id", "relevant", "__l.*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = asked.join(own, ["query_id", *by], "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", *by, "relevant", none(F.col("found") / F.col("relevant")).alias("recall"), none(1 / F.col("first")).alias("reciprocal_rank"), none(F.col("gain") / ideal).alias("ndcg"))
