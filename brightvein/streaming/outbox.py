"""The indexing outbox as a stream: each file of events is drained once, redelivery changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def drain(spark: SparkSession, outbox: str, index: str, dead: str, checkpoint: str, schema, transform: Callable[[DataFrame], DataFrame], key: str = "chunk_id", files: int = 1) -> None:
    """Process everything pending in `outbox`, then stop.

    `transform` may add a column `failure`: rows where it is not null failed for
    good and go to `dead` with that reason, the others to `index`. A ValueError
    raised by `transform` itself lays the whole batch aside; any other error
    leaves the batch pending, for its offset is not committed. A redelivered
    batch changes nothing: rows already in `index` are not written again, and a
    batch's failures replace those it told before.
    """
    shape = transform(spark.createDataFrame([], schema)).drop("failure")
    spark.createDataFrame([], shape.schema).write.mode("append").parquet(index)

    def lay_aside(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    def one(batch: DataFrame, number: int) -> None:
        first = batch.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in batch.columns if c != key]))).filter("__n = 1").drop("__n")
        try:
            out = transform(first)
            tells = "failure" in out.columns
            if tells:
                out = out.persist()
                if out.filter("failure IS NOT NULL").limit(1).count():
                    lay_aside(first.join(out.filter("failure IS NOT NULL").select(key, F.col("failure").alias("failure_reason")), key), number)
            good = out.filter("failure IS NULL").drop("failure") if tells else out
            # of the index only the keys that the batch also has are looked at
            known = spark.read.parquet(index).select(key).join(F.broadcast(first.select(key)) if first.limit(100_001).count() <= 100_000 else first.select(key), key, "left_semi")
            good.join(known, key, "left_anti").write.mode("append").parquet(index)
            if tells:
                out.unpersist()
        except ValueError as error:
            lay_aside(first.withColumn("failure_reason", F.lit(type(error).__name__)), number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(outbox)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(outbox_rows: DataFrame, index: DataFrame, dead: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Each event's state and attempts: failed as often as it was laid aside, completed once its point is there, else pending."""
    failed = dead.groupBy(key).agg(F.count("*").alias("failures"))
    out = outbox_rows.select(key).distinct().join(failed, key, "left").join(index.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    n = F.coalesce("failures", F.lit(0))
    state = F.when(F.col("__done"), "completed").when(n > 0, "failed").otherwise("pending")
    return out.select(key, state.alias("state"), (n + F.coalesce(F.col("__done").cast("int"), F.lit(0))).alias("attempts"))


def pending(outbox_rows: DataFrame, index: DataFrame, dead: DataFrame, order: list[str], size: int, key: str = "chunk_id") -> DataFrame:
    """The first events that are neither completed nor failed, oldest first."""
    open_ = states(outbox_rows, index, dead, key).filter("state = 'pending'").select(key)
    return outbox_rows.join(open_, key, "left_semi").orderBy(*order, key).limit(size)
