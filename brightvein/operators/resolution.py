"""Resolution of names in texts: every alias is sought in every text, and one that several entities share is an ambiguity.

Aliases and texts are compared as words (`analysis.words`), so an alias matches
whole words whatever stands between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis

#: Aliases at most that every task holds in one automaton; more are joined by their number of words.
MOST = 200_000
RESOLVED, AMBIGUOUS = "resolved", "ambiguous"


def worded(text: Column) -> Column:
    """A text as its words, a blank between and around them."""
    return F.concat(F.lit(" "), F.array_join(analysis.words(text), " "), F.lit(" "))


def known_names(aliases: DataFrame) -> DataFrame:
    """`alias` (as words), `entities` and `status`: aliases with all they may stand for."""
    own = aliases.select(F.trim(worded(F.col("alias"))).alias("alias"), "entity").filter("alias <> '' AND entity IS NOT NULL")
    named = own.groupBy("alias").agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    return named.withColumn("status", F.when(F.size("entities") == 1, RESOLVED).otherwise(AMBIGUOUS))


def mentions(texts: DataFrame, aliases: DataFrame, key: str, text_col: str = "text", most: int = MOST) -> DataFrame:
    """`key`, `alias`: each alias that a text holds, once. `aliases` has `alias`, as `known_names` gives it."""
    names = aliases.select("alias").distinct()
    held = names.limit(most + 1).collect()
    rows = texts.select(F.col(key).alias("key"), worded(F.col(text_col)).alias("w")).filter("w IS NOT NULL")
    kind = texts.schema[key].dataType.simpleString()
    if len(held) <= most:
        found = rows.mapInArrow(_automaton([r["alias"] for r in held]), f"key {kind}, alias string")
    else:
        # windows of as many words as some alias has
        lengths = [r[0] for r in names.select(F.size(F.split("alias", " "))).distinct().collect()]
        ws = rows.select("key", F.filter(F.split("w", " "), lambda x: x != "").alias("ws"))
        window = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " ")))
        parts = [ws.select("key", F.explode(F.array_distinct(window(n))).alias("alias")).join(names, "alias") for n in lengths]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    return found.select(F.col("key").alias(key), "alias")


def _automaton(names: list[str]):
    """The function that runs each text through one automaton of all aliases."""

    def work(batches):
        import ahocorasick
        import pyarrow as pa

        tree = ahocorasick.Automaton()
        for n in names:
            tree.add_word(f" {n} ", n)
        if names:
            tree.make_automaton()
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                hits = dict.fromkeys(n for _, n in tree.iter(text)) if names else ()
                at += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "alias"])

    return work


def resolve(texts: DataFrame, aliases: DataFrame, key: str, text_col: str = "text", most: int = MOST) -> DataFrame:
    """`key`, `alias`, `entities`, `status`: what each text names; where `status` is ambiguous, `entities` are the choices to ask about. `aliases` has `alias` and `entity`."""
    names = known_names(aliases)
    return mentions(texts, names, key, text_col, most).join(names, "alias").select(key, "alias", "entities", "status")
