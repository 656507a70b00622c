"""From a question's two ranked lists to its final passages: hybrid search, fallback, reranking, the final window.

Lists are rows of `query_id`, `key`, `kind` (narrative or table-derived) and
`score`. Every step takes many questions at once. `degraded` names what had to
be done without.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..seams import Reranker, Unavailable
from . import retrieval as R

#: Kinds of evidence, and the flags for what is missing.
NARRATIVE, TABLE = "narrative", "table_derived"
NO_DENSE, LEXICAL_FALLBACK, NO_RERANKER = "dense_unavailable", "lexical_fallback_postgres_fts", "reranker_unavailable"
DEPTH = 25


@dataclass
class Hits:
    """A ranked DataFrame, and the flags for what it had to do without."""

    rows: DataFrame
    degraded: tuple[str, ...] = ()
    retriever: str = "bm25"


def lexical_with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> Hits:
    """The primary's hits; the fallback's with a flag if the primary is unavailable. No hits are not a failure."""
    try:
        return Hits(primary())
    except Unavailable:
        return Hits(fallback(), (LEXICAL_FALLBACK,), "fts")


def by_kind(hits: DataFrame, key: str, limit: int, share: float = 0.6) -> DataFrame:
    """Each question's best `limit` of every kind with ranks restarting per kind, then allocated to `limit` places."""
    own = R.ranked(hits.select("query_id", key, "kind", "score"), ["query_id", "kind"], [F.desc("score"), key], limit)
    return R.allocate(own, limit, "kind", NARRATIVE, share)


def hybrid(lexical: Hits, dense: Callable[[], DataFrame], key: str, limit: int, k: int = 60, share: float = 0.6) -> Hits:
    """Reciprocal rank fusion of both lists, each allocated by kind; the ranks fused are those within the kind.

    If the dense side is unavailable all of its hits fall away, with one flag.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    lists = by_kind(lexical.rows, key, limit, share).withColumn("retriever", F.lit(lexical.retriever))
    degraded = list(lexical.degraded)
    try:
        lists = lists.unionByName(by_kind(dense(), key, limit, share).withColumn("retriever", F.lit("dense")))
    except Unavailable:
        degraded.append(NO_DENSE)
    return Hits(R.fuse(lists, key, k, limit), tuple(dict.fromkeys(degraded)), lexical.retriever)


def overlap(fused: DataFrame, one: str, other: str) -> DataFrame:
    """Per question how many of the fused hits both retrievers found, and how many only one."""
    found = lambda name: F.map_contains_key("contributions", F.lit(name))
    return fused.groupBy("query_id").agg(F.count_if(found(one) & found(other)).alias("both"), F.count_if(found(one) & ~found(other)).alias(f"only_{one}"), F.count_if(~found(one) & found(other)).alias(f"only_{other}"))


def rerank(fused: Hits, queries: DataFrame, passages: DataFrame, key: str, scorer: Reranker | None) -> Hits:
    """The hits in order of the scorer's score (ties by key) as `place`, with `rerank_score`.

    `queries` has `query_id` and `text`, `passages` has `key` and `text`; a hit
    without a passage falls away. A scorer that is unavailable, told by a call
    on the driver before the data is read, leaves the fused order, with a flag.
    """
    if scorer is None:
        return Hits(fused.rows.withColumn("rerank_score", F.lit(None).cast("double")), fused.degraded, fused.retriever)
    try:
        scorer("", [""])
    except Unavailable:
        return Hits(fused.rows.withColumn("rerank_score", F.lit(None).cast("double")), (*fused.degraded, NO_RERANKER), fused.retriever)
    asked = fused.rows.join(queries.select("query_id", F.col("text").alias("question")), "query_id").join(passages.select(key, F.col("text").alias("passage")), key)
    schema = T.StructType([*asked.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def work(batches):
        for b in batches:
            b = b.copy()
            b["rerank_score"] = 0.0
            for question, at in b.groupby("question", sort=False).groups.items():
                b.loc[at, "rerank_score"] = scorer(question, b.loc[at, "passage"].tolist())
            yield b

    scored = asked.mapInPandas(work, schema).drop("question", "passage", "place")
    return Hits(R.ranked(scored, ["query_id"], [F.desc("rerank_score"), key], None, "place"), fused.degraded, fused.retriever)


def stand_in_score(query: Column, text: Column) -> Column:
    """The score of `seams.stand_in_reranker` as an expression."""
    head = F.conv(F.substring(F.sha2(F.concat(query, F.lit("\0"), text), 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def collapse(hits: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """Of each question's hits by `place`, those that share no element with one kept before; each with what it absorbed.

    `absorbed` lists (key, shared): a later hit goes to the first kept one it
    shares an element with. What was removed removes nothing. `elements` has
    `key` and `elements`, an array; hits without any always stay.
    """
    found = hits.join(elements.select(key, "elements"), key, "left").withColumn("elements", F.coalesce("elements", F.array().cast(elements.schema["elements"].dataType)))
    items = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("key"), "elements"))).alias("items"))
    kept = items.withColumn("kept", R.greedy_dedupe(F.col("items")))
    gone = F.filter("items", lambda x: ~F.exists("kept", lambda h: h["key"] == x["key"]))
    own = kept.select("query_id", "kept", gone.alias("gone")).select("query_id", "kept", F.explode_outer("gone").alias("x"))
    owner = F.try_element_at(F.filter("kept", lambda h: F.arrays_overlap(h["elements"], F.col("x")["elements"])), F.lit(1))
    links = own.filter("x IS NOT NULL").select("query_id", owner["key"].alias(key), F.struct(F.col("x")["key"].alias("key"), F.size(F.array_intersect(owner["elements"], F.col("x")["elements"])).alias("shared")).alias("link"))
    absorbed = links.groupBy("query_id", key).agg(F.array_sort(F.collect_list("link")).alias("absorbed"))
    stays = kept.select("query_id", F.explode("kept").alias("x")).select("query_id", F.col("x")["key"].alias(key))
    out = hits.join(stays, ["query_id", key]).join(absorbed, ["query_id", key], "left")
    return out.withColumn("absorbed", F.coalesce("absorbed", F.array().cast(absorbed.schema["absorbed"].dataType)))


def renumbered(hits: DataFrame, order: str = "place", name: str = "rank") -> DataFrame:
    """Ranks from 1 without gaps over what is left of each question's hits."""
    return R.ranked(hits, ["query_id"], [order], None, name)


def final_window(hits: Hits, elements: DataFrame, passages: DataFrame, citations: DataFrame, key: str, limit: int) -> Hits:
    """The results: copies collapsed, unknown passages left out, ranks renumbered, and only then cut to `limit`.

    `passages` has `key` and whatever a result shows; `citations` has `key`,
    `position`, `element_id` and `locator`, and becomes an ordered list.
    """
    listed = citations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "element_id", "locator"))).alias("citations"))
    shown = collapse(hits.rows, elements, key).join(passages, key).join(listed, key, "left")
    shown = shown.withColumn("citations", F.coalesce("citations", F.array().cast(listed.schema["citations"].dataType)))
    return Hits(renumbered(shown).filter(F.col("rank") <= limit), hits.degraded, hits.retriever)


def window_depth(limit: int, depth: int = DEPTH) -> int:
    """How many fused hits a search for `limit` results asks for."""
    return max(depth, limit)
