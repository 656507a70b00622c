"""Generations and extraction runs as append-only events; a state is what the last event says.

Events of generations: `generation_id`, `version_id`, `run_id`, `config`,
`state` (shadow, active, superseded, failed) and `seq`, which rises. Every
change is a DataFrame of new events to append; what may not happen is refused
before anything is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lifecycle import latest

SCHEMA = "generation_id string, version_id string, run_id string, config string, state string, seq long"
RUN_SCHEMA = "run_id string, version_id string, config string, state string, elements long, seq long"
SHADOW, ACTIVE, SUPERSEDED, FAILED = "shadow", "active", "superseded", "failed"


class Refused(ValueError):
    """The change would break a rule of the state machine."""


def current(events: DataFrame) -> DataFrame:
    """Each generation's last event."""
    return latest(events, ["generation_id"], ["seq"])


def _next(events: DataFrame, at: int | None) -> int:
    return at if at is not None else (events.agg(F.max("seq")).first()[0] or 0) + 1


def _set(events: DataFrame, ids: list[str], state: str, allowed: tuple[str, ...], at: int | None) -> DataFrame:
    own = current(events).filter(F.col("generation_id").isin(ids)).collect()  # the ids are named by the caller
    missing = set(ids) - {r["generation_id"] for r in own}
    wrong = [r["generation_id"] for r in own if r["state"] not in allowed]
    if missing or wrong:
        raise Refused(f"{state}: unknown {sorted(missing)}, not {' or '.join(allowed)} {sorted(wrong)}")
    return current(events).filter(F.col("generation_id").isin(ids)).withColumn("state", F.lit(state)).withColumn("seq", F.lit(_next(events, at)).cast("long"))


def open_shadow(events: DataFrame, generation_id: str, version_id: str, config: str, run_id: str | None = None, at: int | None = None) -> DataFrame:
    """A new generation; refused if one that has not failed exists for the same version, run and configuration."""
    same = for_configuration(events, version_id, run_id, config)
    if same.limit(1).count() or events.filter(F.col("generation_id") == generation_id).limit(1).count():
        raise Refused("there is one already")
    return events.sparkSession.createDataFrame([(generation_id, version_id, run_id, config, SHADOW, _next(events, at))], SCHEMA)


def attach_run(events: DataFrame, generation_id: str, run_id: str, at: int | None = None) -> DataFrame:
    return _set(events, [generation_id], SHADOW, (SHADOW,), at).withColumn("run_id", F.lit(run_id))


def activate(events: DataFrame, generation_id: str, at: int | None = None) -> DataFrame:
    """The shadow becomes active, and its version's active one is superseded by the same append; it needs a run."""
    new = _set(events, [generation_id], ACTIVE, (SHADOW,), at)
    own = new.first()
    if own["run_id"] is None:
        raise Refused("an active generation needs an extraction run")
    old = current(events).filter((F.col("version_id") == own["version_id"]) & (F.col("state") == ACTIVE))
    return old.withColumn("state", F.lit(SUPERSEDED)).withColumn("seq", F.lit(own["seq"]).cast("long")).unionByName(new)


def fail(events: DataFrame, generation_id: str, at: int | None = None) -> DataFrame:
    return _set(events, [generation_id], FAILED, (SHADOW, FAILED), at)


def reopen(events: DataFrame, generation_id: str, at: int | None = None) -> DataFrame:
    return _set(events, [generation_id], SHADOW, (FAILED,), at)


def active_ids(events: DataFrame) -> DataFrame:
    return current(events).filter(F.col("state") == ACTIVE).select("generation_id")


def active_for(events: DataFrame, version_id: str) -> DataFrame:
    return current(events).filter((F.col("state") == ACTIVE) & (F.col("version_id") == version_id))


def for_configuration(events: DataFrame, version_id: str, run_id: str | None, config: str) -> DataFrame:
    """Generations that have not failed, built from just this."""
    return current(events).filter((F.col("version_id") == version_id) & F.col("run_id").eqNullSafe(F.lit(run_id)) & (F.col("config") == config) & (F.col("state") != FAILED))


def activated_at(events: DataFrame) -> DataFrame:
    """Per generation the number of the event that made it active."""
    return events.filter(F.col("state") == ACTIVE).groupBy("generation_id").agg(F.max("seq").alias("activated"))


def prunable(events: DataFrame, include_failed: bool = False) -> DataFrame:
    """Superseded (and failed) generations, the newest first."""
    return current(events).filter(F.col("state").isin([SUPERSEDED, *([FAILED] if include_failed else [])])).orderBy(F.desc("seq"), F.desc("generation_id")).select("generation_id", "seq")


def finish(events: DataFrame, generation_id: str, outbox: DataFrame, points: DataFrame, at: int | None = None) -> DataFrame:
    """Activation if all chunks queued are completed and indexed, failure if not.

    `outbox` has `generation_id` and `state`, `points` has `generation_id`.
    """
    own = outbox.filter(F.col("generation_id") == generation_id).agg(F.count("*").alias("queued"), F.count_if(F.col("state") == "completed").alias("completed")).first()
    indexed = points.filter(F.col("generation_id") == generation_id).count()
    if own["queued"] == own["completed"] == indexed:
        return activate(events, generation_id, at)
    return fail(events, generation_id, at)


def index_consistency(events: DataFrame, chunks: DataFrame, points: DataFrame | None) -> DataFrame:
    """One row: points and children of active generations, and whether they agree (null without points to be read)."""
    active = active_ids(events)
    children = chunks.filter("role = 'child'").join(F.broadcast(active), "generation_id", "left_semi").agg(F.count("*").alias("children"))
    if points is None:
        return children.select(F.lit(None).cast("long").alias("points"), "children", F.lit(None).cast("boolean").alias("agree"))
    own = points.join(F.broadcast(active), "generation_id", "left_semi").agg(F.count("*").alias("points"))
    return own.withColumn("one", F.lit(1)).join(children.withColumn("one", F.lit(1)), "one").select("points", "children", (F.col("points") == F.col("children")).alias("agree"))


@dataclass
class Pruned:
    prunable: list[str]
    points_before: int
    points_prunable: int
    active_before: int
    applied: bool = False
    removed: int = 0
    points_after: int | None = None


def prune(spark: SparkSession, events: DataFrame, index: str, include_failed: bool = False, confirm: bool = False) -> Pruned:
    """What pruning would remove from the index under `index` (Parquet with `generation_id`, as a column or as folders); with `confirm`, removes it.

    The number of active points must be the same before and after. Folders suit
    few generations; with many, keep the id as a column.
    """
    from ..sources import sinks

    ids = [r["generation_id"] for r in prunable(events, include_failed).collect()]
    states = current(events).select("generation_id", "state")
    gone = (SUPERSEDED, FAILED) if include_failed else (SUPERSEDED,)

    def points() -> dict:
        """Points by the state of their generation, in one pass over the index."""
        found = spark.read.parquet(index).schema
        # folders that look like numbers are read as such: the ids are texts
        read = spark.read.schema(T.StructType([T.StructField("generation_id", T.StringType()) if f.name == "generation_id" else f for f in found]))
        each = read.parquet(index).groupBy("generation_id").agg(F.count("*").alias("n"))
        return {r["state"]: r["n"] for r in each.join(states, "generation_id", "left").groupBy("state").agg(F.sum("n").alias("n")).collect()}

    before = points()
    report = Pruned(ids, sum(before.values()), sum(before.get(s, 0) for s in gone), before.get(ACTIVE, 0))
    if not confirm or not ids:
        return report
    report.removed = sinks.delete_generations(spark, index, states.filter(F.col("state").isin(*gone)))
    after = points() if report.removed < report.points_before else {}
    if after.get(ACTIVE, 0) != report.active_before:
        raise Refused("active points changed while pruning: rebuild the index")
    report.points_after, report.applied = sum(after.values()), True
    return report


def start_run(runs: DataFrame, run_id: str, version_id: str, config: str, at: int | None = None) -> DataFrame:
    """A run starts as failed, so one that dies is; refused if one that has not failed exists for this configuration."""
    own = latest(runs, ["run_id"], ["seq"])
    if own.filter((F.col("version_id") == version_id) & (F.col("config") == config) & (F.col("state") != FAILED)).limit(1).count():
        raise Refused("this configuration has a run")
    return runs.sparkSession.createDataFrame([(run_id, version_id, config, FAILED, 0, _next(runs, at))], RUN_SCHEMA)


def run_state(elements: DataFrame) -> str:
    """`failed` without elements, `partial` if any has a failure reason, else `succeeded`."""
    s = elements.agg(F.count("*").alias("n"), F.count_if(F.col("failure_reason").isNotNull()).alias("gaps")).first()
    return FAILED if not s["n"] else "partial" if s["gaps"] else "succeeded"


def complete_run(runs: DataFrame, run_id: str, elements: DataFrame, at: int | None = None) -> DataFrame:
    own = latest(runs, ["run_id"], ["seq"]).filter(F.col("run_id") == run_id)
    if not own.limit(1).count():
        raise Refused("no such run")
    return own.withColumn("state", F.lit(run_state(elements))).withColumn("elements", F.lit(elements.count()).cast("long")).withColumn("seq", F.lit(_next(runs, at)).cast("long"))


def current_runs(runs: DataFrame) -> DataFrame:
    """Each version's current run: its last one that has not failed."""
    own = latest(runs, ["run_id"], ["seq"]).filter(F.col("state") != FAILED)
    return latest(own, ["version_id"], ["seq"])
