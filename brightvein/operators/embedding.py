"""Embedding of texts by an injected model: batched, prefixed, checked, at unit length, and remembered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit_vector
from ..seams import Embedder
from . import reports

#: What is put before a text, by its kind, and the longest text taken.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}
LONGEST, BATCH = 6000, 32


def embed(texts: DataFrame, model: Embedder, dimensions: int, kind: str = "document", text_col: str = "text", tell: bool = False) -> DataFrame:
    """`texts` with `vector`, each of the given length and at length one (a zero vector stays).

    A text longer than `LONGEST` characters, and an answer of another shape,
    are errors, as a cut text would silently stand for the whole. With `tell`
    they are not raised: the rows concerned have a null vector and say why in
    `failure`, and the others go on. Null texts get null vectors.
    """
    schema = texts.schema
    prefix = PREFIXES[kind]

    def work(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            out: list = [None] * len(b)
            why: list = [None] * len(b)
            at = [i for i, t in enumerate(b[text_col]) if t is not None]
            if tell:
                for i in at:
                    why[i] = "TextTooLong" if len(b[text_col].iloc[i]) > LONGEST else None
                at = [i for i in at if why[i] is None]
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                sent = [b[text_col].iloc[j] for j in part]
                if any(len(t) > LONGEST for t in sent):
                    raise ValueError(f"a text has more than {LONGEST} characters")
                got = model([prefix + t for t in sent])
                if len(got) != len(sent) or any(len(v) != dimensions for v in got):
                    if tell:
                        for j in part:
                            why[j] = "WrongShape"
                        continue
                    raise ValueError(f"the model did not give {len(sent)} vectors of {dimensions} numbers")
                for j, v in zip(part, got):
                    out[j] = [float(x) for x in v]
            made = b.assign(vector=pd.Series(out, index=b.index, dtype=object))
            yield made.assign(failure=pd.Series(why, index=b.index, dtype=object)) if tell else made

    from pyspark.sql import types as T

    made = texts.mapInPandas(work, T.StructType([*schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType())), *([T.StructField("failure", T.StringType())] if tell else [])]))
    return made.withColumn("vector", F.when(F.col("vector").isNotNull(), unit_vector(F.col("vector"))))


def embed_cached(texts: DataFrame, cache: DataFrame, model: Embedder, dimensions: int, name: str, config: str, kind: str = "document") -> tuple[DataFrame, DataFrame]:
    """`texts` with `vector`, and the cache rows to add: each text that the cache lacks is embedded once.

    `cache` has `digest`, `text`, `model`, `config`, `kind` and `vector`; an
    entry counts only if its text is equal, not just its digest.
    """
    mine = cache.filter((F.col("model") == name) & (F.col("config") == config) & (F.col("kind") == kind)).select("text", "vector")
    wanted = texts.filter("text IS NOT NULL").select("text").dropDuplicates(["text"])
    misses = reports.cache_misses(wanted, mine.select("text")).select("text")
    new = embed(misses, model, dimensions, kind)
    rows = reports.digested(new).select("digest", "text", F.lit(name).alias("model"), F.lit(config).alias("config"), F.lit(kind).alias("kind"), "vector")
    known = reports.cache_hits(wanted, mine).select("text", "vector").unionByName(new.select("text", "vector"))
    out = reports.digested(texts).join(reports.digested(known).withColumnRenamed("text", "__known"), "digest", "left").filter("text IS NULL OR text = __known")
    return out.drop("__known", "digest"), rows


def refuse_over_long(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """The texts that `embed` would refuse."""
    return texts.filter(F.length(text_col) > longest)
