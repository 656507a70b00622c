"""Helpers the training-data operators share: written tables, size-checked broadcasts, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte class that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster, whose
    executors would not see that, gets an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brightvein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage the way ``checkpoint()`` does, survives lost
    executors, and keeps the columns prunable.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brightvein_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables nothing lazy depends on any more."""
    for df in frames:
        path = getattr(df, "_brightvein_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone by now
            _delete(spark, path)


def rows_of(df: DataFrame) -> int:
    """The rows of a written table, from its files' footers; read once."""
    if getattr(df, "_brightvein_rows", None) is None:
        df._brightvein_rows = df.count()
    return df._brightvein_rows


def small(df: DataFrame, rows: int, of: DataFrame | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise unchanged, so that Spark shuffles.

    ``df`` should be a written table, or have no more rows than the written table ``of``.
    """
    return F.broadcast(df) if rows_of(df if of is None else of) <= rows else df


def text_of(text: str | Column) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for an empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def fresh_name(base: str, taken: list[str]) -> str:
    """A column name that no input column clashes with (Spark compares names without case)."""
    used, name = {c.lower() for c in taken}, base
    while name.lower() in used:
        name = f"_{name}"
    return name
