"""Lookups, listings and reports over the engine's relations. Every operator takes DataFrames and the names of their columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


def scoped(rows: DataFrame, owners: DataFrame, key: str, owner_key: str, details: DataFrame | None = None, detail_key: tuple[str, str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows under a filter with their owner, which they must have, and the owner's details, which may be missing.

    `detail_key` names the owner's column and that of `details` it is matched on.
    """
    own = (rows if where is None else rows.filter(where)).join(owners, F.col(key) == F.col(owner_key))
    return own if details is None else own.join(details, F.col(detail_key[0]) == F.col(detail_key[1]), "left")


def parents(rows: DataFrame, key: str, parent: Column, agrees: Column | None = None) -> DataFrame:
    """(`child`, `parent`) keys of rows whose parent is there. `parent` is computed from the child; `agrees` reads `child.` and `parent.` columns."""
    child = rows.withColumn("__parent", parent).alias("child")
    both = child.join(rows.alias("parent"), F.col("child.__parent") == F.col(f"parent.{key}"))
    return (both if agrees is None else both.filter(agrees)).select(F.col(f"child.{key}").alias("child"), F.col(f"parent.{key}").alias("parent"))


def load_context(rows: DataFrame, wanted: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """The wanted rows, with their details where there are any."""
    return rows.join(wanted.select(key), key, "left_semi").join(details, key, "left")


def pending_batch(rows: DataFrame, state: str, pending, order: list[str], size: int) -> DataFrame:
    """The first rows in a state: what is worked on next."""
    return rows.filter(F.col(state) == pending).orderBy(*order).limit(size)


def listed_in_order(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Each key's values as one list in order."""
    fields = [*order, *([value] if value not in order else [])]
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x[value]).alias(name))


def with_list(rows: DataFrame, parts: DataFrame, key: str, part_key: str, value: str, name: str) -> DataFrame:
    """Each key with the sorted list of its parts' values; an empty one where it has no part."""
    listed = parts.groupBy(F.col(part_key).alias("__key")).agg(F.sort_array(F.collect_list(value)).alias(name))
    return rows.select(key).join(listed, F.col(key) == F.col("__key"), "left").select(key, F.coalesce(name, F.array().cast(listed.schema[name].dataType)).alias(name))


def within(rows: DataFrame, scope: DataFrame, key: str, scope_key: str) -> DataFrame:
    """Rows whose key is in scope."""
    return rows.join(scope.select(F.col(scope_key).alias("__scope")), F.col(key) == F.col("__scope"), "left_semi")


def outside(rows: DataFrame, scope: DataFrame, key: str, scope_key: str) -> DataFrame:
    """Rows whose key is not in scope."""
    return rows.join(scope.select(F.col(scope_key).alias("__scope")), F.col(key) == F.col("__scope"), "left_anti")


def guard_apart(a: DataFrame, b: DataFrame, key: str) -> None:
    """Refuse two sets that share a key."""
    shared = a.join(b, key, "left_semi").select(key).limit(5).collect()
    if shared:
        raise ValueError(f"in both sets: {[r[0] for r in shared]}")


def current_rows(owners: DataFrame, rows: DataFrame, pointer: str, key: str) -> DataFrame:
    """The row that each owner's pointer names; owners without one are absent."""
    return owners.join(rows, F.col(pointer) == F.col(key))


def digested(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with `digest`, the SHA-256 of the text."""
    return rows.withColumn("digest", F.sha2(text, 256))


def cache_hits(rows: DataFrame, cache: DataFrame, text: str = "text", on: tuple[str, ...] = ()) -> DataFrame:
    """Rows joined with the cached ones of equal digest (and `on` columns) whose text is equal too; only digests are shuffled as keys."""
    left, right = digested(rows, text).withColumnRenamed(text, "__a"), digested(cache, text).withColumnRenamed(text, "__b")
    return left.join(right, ["digest", *on]).filter("__a = __b").withColumnRenamed("__a", text).drop("__b")


def cache_misses(rows: DataFrame, cache: DataFrame, text: str = "text", on: tuple[str, ...] = ()) -> DataFrame:
    """The different texts the cache lacks, by digest with the text rechecked."""
    left, right = digested(rows, text).alias("a"), digested(cache, text).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("digest", *on, text)])
    return left.join(right, same, "left_anti").dropDuplicates(["digest", *on])


def counts(rows: DataFrame, by: list[str] | None = None, **when: Column) -> DataFrame:
    """`total` rows, and for each name how many meet its condition, in one pass."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in when.items()))


def half_even_median(value: str) -> Column:
    """The interpolated median as a whole number, halves to the even one."""
    return F.rint(F.percentile(value, F.lit(0.5))).cast("long")


def listing(owners: DataFrame, key: str, *measures: DataFrame) -> DataFrame:
    """Owners with measures that were each summed by `key` before they are joined; what an owner lacks is null."""
    return reduce(lambda out, m: out.join(m, key, "left"), measures, owners)


def most_frequent(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Each key's `k` most frequent values that are not blank, with `n`; ties by value."""
    n = rows.filter(F.trim(value) != "").groupBy(*by, value).agg(F.count("*").alias("n"))
    return ranked(n, by, [F.desc("n"), value], k)


def distinct_sorted(rows: DataFrame, value: str, limit: int) -> DataFrame:
    return rows.select(value).filter(F.col(value).isNotNull()).distinct().orderBy(value).limit(limit)


def facets(rows: DataFrame, columns: list[str], suffix: str = "s") -> DataFrame:
    """One row: per column its different values, sorted, without nulls and empty ones."""
    return rows.agg(*(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(f"{c}{suffix}") for c in columns))


def activity(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group how many, the named quantiles and the most."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.percentile(value, F.lit(q)).alias(n) for n, q in shares.items()), F.max(value).alias("most"))


def element_frequency(rows: DataFrame, elements: Column, name: str) -> DataFrame:
    """How often each element of an array column occurs."""
    return rows.select(F.explode(elements).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def since_last(rows: DataFrame, at: str, days: int) -> Column:
    """Whether a row was used in the `days` up to the last use of any, as a scalar subquery of the same plan."""
    last = rows.agg(F.max(at).alias("last"))
    return F.col(at) >= last.select(F.col("last") - F.make_interval(days=F.lit(days))).scalar()


def cache_statistics(rows: DataFrame, at: str, kind: str, days: int) -> DataFrame:
    """One row: entries, first and last use, entries not used lately, and kinds."""
    used = rows.withColumn("__used", since_last(rows, at, days))
    return used.agg(F.count("*").alias("entries"), F.min(at).alias("first_used"), F.max(at).alias("last_used"), F.count_if(~F.col("__used")).alias("unused"), F.countDistinct(kind).alias("kinds"))


def split_violations(rows: DataFrame, owner: str, split: str) -> DataFrame:
    """Owners in more than one split; where the owner is a text, group by its digest."""
    return rows.groupBy(owner).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def run_states(owners: DataFrame, rows: DataFrame, key: str, row_key: str, gap: Column) -> DataFrame:
    """Owners' states: failed without rows, partial with any gap, else succeeded."""
    per = rows.groupBy(F.col(row_key).alias("__key")).agg(F.coalesce(F.bool_or(gap), F.lit(False)).alias("__gap"))
    state = F.when(F.col("__gap").isNull(), "failed").when(F.col("__gap"), "partial").otherwise("succeeded")
    return owners.select(key).join(per, F.col(key) == F.col("__key"), "left").select(key, state.alias("state"))


def ready(rows: DataFrame, unhealthy: Column) -> DataFrame:
    """One row: whether nothing essential is unhealthy; nothing at all is ready."""
    return rows.agg(F.coalesce(~F.bool_or(unhealthy), F.lit(True)).alias("ready"))


def rate(rows: DataFrame, by: list[str], hit: Column, name: str = "hit_rate", **sums: str) -> DataFrame:
    """Share of rows that hit, 0 for none, and sums of other columns."""
    return rows.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), F.lit(0.0)).alias(name), *(F.sum(c).alias(n) for n, c in sums.items()))


def latest_value(rows: DataFrame, by: list[str], value: str, order: list[str], name: str = "latest") -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(name))


def agreement(predicted: DataFrame, truth: DataFrame, key: str, by: str, hit: Column) -> DataFrame:
    """Per group how many were judged and how many of these hit; what the truth does not count as a number is left out by the caller's `try_cast`."""
    return predicted.join(truth, key).groupBy(by).agg(F.count("*").alias("scored"), F.count_if(hit).alias("hits"))


def headline(rows: DataFrame, size: str, unreadable: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("documents"), F.sum(size).alias("chars"), F.count_if(unreadable).alias("unreadable"))


def funnel(stages: DataFrame, by: str, returned: int, collapsed: Column, stage: str, order: list[str]) -> DataFrame:
    """Per search what fell away between depth and result, never below 0, and its slowest stage."""
    return stages.groupBy(by).agg(F.greatest(F.count("*") - returned - F.count_if(collapsed), F.lit(0)).alias("dropped"), F.max_by(stage, F.struct(*order)).alias("slowest"))


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """Each key's different values in the order of their first occurrence."""
    first = rows.groupBy(*by, value).agg(F.min(order).alias("__first"))
    return listed_in_order(first, by, ["__first", value], value, name)


def batch_dedupe(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each different text once: `digest`, `first_id`, `times`. Rows meet by digest; the texts are compared within it."""
    per = digested(rows, text).groupBy("digest", F.xxhash64(text).alias("__h")).agg(F.min(key).alias("first_id"), F.count("*").alias("times"))
    return per.drop("__h")


def attempts(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """Attempts so far and the state that the last event says."""
    return events.groupBy(key).agg(F.count("*").alias("attempts"), F.max_by(state, order).alias("state"))


def durations(rows: DataFrame, by: str, at: str, order: list[str], name: str = "micros") -> DataFrame:
    """Microseconds to the key's next row."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.withColumn(name, us(F.lead(at).over(Window.partitionBy(by).orderBy(*order))) - us(F.col(at)))


def out_of_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is less than the one before."""
    return rows.withColumn("__bad", F.col(value) < F.lag(value).over(Window.partitionBy(by).orderBy(order))).filter("__bad").drop("__bad")


def nearest_before(rows: DataFrame, by: str, at: str, value: str, kind: str, hours: int, name: str) -> DataFrame:
    """For each row, the last earlier one of its key and another kind, within some hours: `value` of both.

    One window per kind instead of a self-join: a row's last predecessors of
    every kind lie in a map that the window carries along.
    """
    micros = rows.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    w = Window.partitionBy(by).orderBy("__at").rangeBetween(-hours * 3_600_000_000, -1)
    kinds = [r[0] for r in rows.select(kind).distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("too many kinds")
    last = {k: F.max(F.when(F.col(kind) == k, F.struct("__at", value))).over(w) for k in kinds if k is not None}
    others = [F.when(F.col(kind) != k, c) for k, c in last.items()]
    best = F.array_max(F.array(*others))
    return micros.withColumn("__best", best).filter("__best IS NOT NULL").select(value, F.col("__best")[value].alias(name))
