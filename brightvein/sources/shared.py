"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under `spark.checkpoint.dir`; where that is unset, a local master gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brightvein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str, part: str) -> None:
    """Writes a table that is kept, in folders by `part`, with its schema beside it: a table without rows has no files that tell it."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}-schema")
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """What `keep` wrote."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}-schema").first()[0]))
    return spark.read.schema(schema).parquet(path)
