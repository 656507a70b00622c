"""State kept as append-only events, and the writes that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last event of each key: its current state."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).filter("__n = 1").drop("__n")


def upsert(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`current` with `changes` laid over it, the change winning; both have one row a key."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes)


def insert_missing(current: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is new, one for each."""
    return rows.dropDuplicates(key).join(current.select(*key), key, "left_anti")


def one_active(generations: DataFrame, owner: str, order: list) -> DataFrame:
    """Generations with the state activation gives them: each owner's newest active, its earlier ones superseded."""
    w = Window.partitionBy(owner).orderBy(*[F.desc(c) for c in order])
    return generations.withColumn("state", F.when(F.row_number().over(w) == 1, "active").otherwise("superseded"))


def reconciled(queued: int, completed: int, points: int) -> bool:
    """Whether a generation may be activated: all that was queued is completed and indexed."""
    return queued == completed == points


def preconditions(selected: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """What a stage needs and lacks, over the whole selection, before any of it is worked on."""
    return selected.select(key).join(have.select(key), key, "left_anti")


def run_stage(selected: DataFrame, have: DataFrame, done: DataFrame, key: str, config: str, work) -> DataFrame:
    """Apply `work` to each selected row that this configuration has not done yet: `key`, `config`, `failure`, `seconds`.

    Refused as a whole if anything selected lacks what the stage needs. A row
    that fails is told by its error's name, and the others go on. `done` has
    `key`, `config` and `failure`.
    """
    lacking = [r[0] for r in preconditions(selected, have, key).limit(5).collect()]
    if lacking:
        raise ValueError(f"not ready: {lacking}")
    finished = done.filter((F.col("config") == config) & F.col("failure").isNull()).select(key)
    due = selected.join(finished, key, "left_anti")
    names = due.columns

    def one(batches):
        import time

        import pandas as pd

        for b in batches:
            out = []
            for row in b[names].itertuples(index=False):
                start, failure = time.perf_counter(), None
                try:
                    work(row._asdict())
                except Exception as error:  # told in the row; the stage goes on
                    failure = type(error).__name__
                out.append((getattr(row, key), config, failure, time.perf_counter() - start))
            yield pd.DataFrame(out, columns=[key, "config", "failure", "seconds"])

    return due.mapInPandas(one, f"{key} {selected.schema[key].dataType.simpleString()}, config string, failure string, seconds double")


def stage_report(results: DataFrame) -> DataFrame:
    """One row: rows worked on, failures, and seconds in all."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("failure").isNotNull()).alias("failures"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
