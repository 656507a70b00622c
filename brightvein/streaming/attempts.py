"""Attempts and back-off of each event, kept as the state of a stream.

A stream of outcomes (event, whether it went well, when) is grouped by event.
The state of an event is its number of attempts, how it stands and when it is
due again; it survives restarts with the stream's checkpoint. Each change is
told as a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts after which an event has failed, and the seconds before the second; each later one waits twice as long.
MOST, WAIT = 5, 30
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "chunk_id long, attempts int, state string, due timestamp"


class _Attempts(StatefulProcessor):
    def __init__(self, most: int, wait: int):
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "attempts int, state string, due timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803  (the interface's names)
        import pandas as pd

        told = pd.concat(list(rows)).sort_values(["at", "ok"], kind="stable")
        attempts, state, due = self.kept.get() if self.kept.exists() else (0, "pending", None)
        for ok, at in zip(told["ok"].tolist(), told["at"].tolist()):
            if state != "pending":
                break  # what is completed or failed stays so, whatever is redelivered
            if due is not None and pd.Timestamp(at) < pd.Timestamp(due):
                continue  # told before it was due: the same attempt once more
            attempts += 1
            state = "completed" if ok else "failed" if attempts >= self.most else "pending"
            due = None if state != "pending" else (pd.Timestamp(at) + pd.Timedelta(seconds=self.wait * 2 ** (attempts - 1))).to_pydatetime()
        self.kept.update((attempts, state, due))
        yield pd.DataFrame({"chunk_id": [key[0]], "attempts": [attempts], "state": [state], "due": pd.Series([due], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def track(outcomes: DataFrame, most: int = MOST, wait: int = WAIT) -> DataFrame:
    """A stream of `chunk_id`, `ok`, `at` as a stream of `chunk_id`, `attempts`, `state` (pending, completed, failed) and `due`."""
    return outcomes.groupBy("chunk_id").transformWithStateInPandas(_Attempts(most, wait), COLUMNS, "Update", "None")


def run(spark: SparkSession, outcomes: str, out: str, checkpoint: str, most: int = MOST, wait: int = WAIT, files: int = 1) -> None:
    """Takes in what is new under `outcomes` and writes each event's change under `out`, a folder a batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    told = spark.readStream.schema("chunk_id long, ok boolean, at timestamp").option("maxFilesPerTrigger", files).parquet(outcomes)

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    track(told, most, wait).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def now(changes: DataFrame) -> DataFrame:
    """How each event stands, from the changes written so far."""
    last = changes.groupBy("chunk_id").agg(F.max_by(F.struct("attempts", "state", "due"), "batch").alias("x"))
    return last.select("chunk_id", "x.*")


def due(outbox: DataFrame, changes: DataFrame, at) -> DataFrame:
    """The events of `outbox` to be tried at a time: never tried, or pending and due."""
    known = now(changes)
    return outbox.join(known, "chunk_id", "left").filter(F.col("state").isNull() | ((F.col("state") == "pending") & (F.col("due") <= F.lit(at)))).select(outbox.columns)
