"""Reading of tables, and registration of a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registrar(queries: dict, sql: dict):
    """A decorator that registers `f(t)` over the tables `t` under its name, with its SQL if any."""

    def register(oracle: str | None = None, name: str | None = None):
        def wrap(f: Callable[[Tables], DataFrame]):
            queries[name or f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if oracle:
                sql[name or f.__name__] = oracle
            return f

        return wrap

    return register
