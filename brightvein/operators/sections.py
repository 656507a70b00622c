"""Document structure: heading islands and paths, section and run ids, greedy windows, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island_ids(df: DataFrame, by: list[str], order: str, changes: Column, name: str) -> DataFrame:
    """Number maximal runs within `by`: a run starts where `changes` holds (over `lag` columns) or at the first row."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.sum(F.coalesce(changes.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def runs_of(df: DataFrame, by: list[str], order: str, value: str, name: str = "run") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return island_ids(df.withColumn("__change", first | ~F.col(value).eqNullSafe(before)), by, order, F.col("__change"), name).drop("__change")


def suppress_list_runs(df: DataFrame, by: list[str], order: str, level: str = "level", longest: int = 2) -> DataFrame:
    """Levels of more than `longest` neighbours alike are a list's and set to null."""
    marked = runs_of(df, by, order, level, "__run")
    size = F.count("*").over(Window.partitionBy(*by, "__run"))
    return marked.withColumn(level, F.when(size <= longest, F.col(level))).drop("__run")


def heading_paths(headings: Column) -> Column:
    """The stack of titles after the last of ordered structs (`level`, `title`): each pops the levels at or above its own."""
    empty = F.slice(headings, F.lit(1), F.lit(0))
    return F.transform(F.aggregate(headings, empty, lambda st, h: F.array_append(F.filter(st, lambda x: x["level"] < h["level"]), h)), lambda x: x["title"])


def paths_of_headings(headings: Column) -> Column:
    """For each of ordered structs (`level`, `title`), the stack of titles once it is pushed."""
    start = F.struct(F.slice(headings, F.lit(1), F.lit(0)).alias("stack"), F.array().cast("array<array<string>>").alias("out"))

    def push(acc, h):
        stack = F.array_append(F.filter(acc["stack"], lambda x: x["level"] < h["level"]), h)
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.transform(stack, lambda x: x["title"])).alias("out"))

    return F.aggregate(headings, start, push, lambda acc: acc["out"])


def with_heading_paths(blocks: DataFrame, by: list[str], order: str, level: str = "level", title: str = "text") -> DataFrame:
    """Each block with `heading_path`, the titles above it (its own included); blocks before the first heading have an empty one.

    The headings of one document meet in one row; its other blocks find the
    last heading before them by a running count.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("__section", F.sum(F.col(level).isNotNull().cast("int")).over(w))
    heads = numbered.filter(F.col(level).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(level).alias("level"), F.col(title).alias("title")))).alias("hs"))
    plain = F.transform("hs", lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title")))
    paths = heads.select(*by, F.posexplode(paths_of_headings(plain)).alias("__at", "heading_path")).withColumn("__section", F.col("__at") + 1).drop("__at")
    out = numbered.join(paths, [*by, "__section"], "left")
    return out.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>"))).drop("__section")


def greedy_windows(sizes: Column, budget: int) -> Column:
    """Window numbers of ordered sizes: a new window opens when the next would pass the budget."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, n):
        opens = (acc["used"] > 0) & (acc["used"] + n > budget)
        at = F.when(opens, acc["at"] + 1).otherwise(acc["at"])
        return F.struct(F.when(opens, n.cast("long")).otherwise(acc["used"] + n).alias("used"), at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def bands(df: DataFrame, by: list[str], value: str, gap: float) -> DataFrame:
    """Sorted values split where the gap is wider: `by`, `top`, `bottom`, `members`."""
    w = Window.partitionBy(*by).orderBy(value)
    own = df.select(*by, value).distinct().withColumn("__change", F.coalesce(F.col(value) - F.lag(value).over(w) > gap, F.lit(True)))
    own = island_ids(own, by, value, F.col("__change"), "band")
    return own.groupBy(*by, "band").agg(F.min(value).alias("top"), F.max(value).alias("bottom"), F.count("*").alias("members"))


def contiguous(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers: `by`, `first`, `last`."""
    own = df.select(*by, value).distinct()
    key = F.col(value) - F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return own.withColumn("__k", key).groupBy(*by, "__k").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__k")
