"""Facts: displayed values with their state and canonical value, conflicts between them, and guarded measures over periods.

A value is numeric, zero, nil, missing, not applicable or unreadable; the states
stay apart and none stands for another. What a value is a fact of (its key) and
where it came from are columns of the caller's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NUMERIC, ZERO, NIL, MISSING, NOT_APPLICABLE, UNREADABLE = "numeric", "zero", "nil", "missing", "not_applicable", "parse_failure"
#: How nil and not applicable are displayed, and what scales stand for.
NILS, NOT_APPLICABLES = ("-", "–", "—", "nil"), ("n/a", "na", "n.a.", "not applicable")
FACTORS = {"thousand": 1_000, "thousands": 1_000, "lakh": 100_000, "lakhs": 100_000, "million": 1_000_000, "millions": 1_000_000, "crore": 10_000_000, "crores": 10_000_000, "billion": 1_000_000_000, "billions": 1_000_000_000}
DECIMAL = "decimal(38,10)"


def typed(displayed: Column, scale: Column | None = None) -> Column:
    """A struct of `state`, canonical `value` (null unless numeric or zero) and `places`, the decimals displayed.

    `scale` is a word such as lakh; null is one. A value that 38 digits with ten
    decimals can't hold is a parse failure.
    """
    shown = F.lower(F.trim(F.coalesce(displayed, F.lit(""))))
    found = X.figures(shown)
    alone = X.looks_numeric(shown) & (F.size(found) == 1)
    plain = F.when(alone, F.try_element_at(found, F.lit(1)))
    fits = plain.rlike(r"^-?[0-9]{1,28}([.][0-9]{1,10})?$")
    value = F.when(fits, plain.try_cast(DECIMAL))
    if scale is not None:
        factors = F.create_map(*(F.lit(x) for pair in FACTORS.items() for x in pair))
        times = F.when(scale.isNull(), F.lit(1)).otherwise(F.try_element_at(factors, F.lower(F.trim(scale))))
        value = F.try_multiply(value, times.cast("decimal(10,0)")).try_cast(DECIMAL)
    state = F.when(shown == "", MISSING).when(shown.isin(*NILS), NIL).when(shown.isin(*NOT_APPLICABLES), NOT_APPLICABLE).when(value.isNull(), UNREADABLE).when(value == 0, ZERO).otherwise(NUMERIC)
    places = F.length(F.regexp_extract(shown, r"[.]([0-9]+)", 1))
    return F.struct(state.alias("state"), F.when(state.isin(NUMERIC, ZERO), value).alias("value"), places.alias("places"))


def facts(mentions: DataFrame, displayed: str = "displayed", scale: str | None = None) -> DataFrame:
    """`mentions` with `state`, `value` and `places`; what is displayed, the key and the provenance stay."""
    return mentions.withColumn("__typed", typed(F.col(displayed), F.col(scale) if scale else None)).select(*mentions.columns, "__typed.*")


def conflicts(known: DataFrame, key: list[str]) -> DataFrame:
    """One row a key with different canonical values: their number, least and greatest, `kind` and whether it is `material`.

    Of opposite sign: `sign`; one a power of ten of the other: `scale`; equal
    once rounded to the fewest decimals displayed: `rounding`, which is not
    material; else `value`. Only counts and extremes are aggregated, so a key
    with any number of facts is reduced before the shuffle.
    """
    told = known.filter(F.col("value").isNotNull())
    v = F.col("value")
    own = told.groupBy(*key).agg(F.count("*").alias("facts"), F.count_distinct("value").alias("values"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.min(F.abs(v)).alias("small"), F.max(F.abs(v)).alias("large"), F.min("places").alias("places"))
    power = F.log10(F.try_divide(F.col("large").cast("double"), F.col("small").cast("double")))
    # rounding keeps order: what lies between the extremes rounds as they do
    rounded = lambda c: F.floor(F.col(c).cast("double") * F.pow(F.lit(10.0), F.col("places")) + 0.5)
    kind = F.when(F.col("small") == F.col("large"), "sign").when((F.col("values") == 2) & (power >= 1) & (F.abs(power - F.round(power)) < 1e-12), "scale").when(rounded("least") == rounded("greatest"), "rounding").otherwise("value")
    return own.filter("values > 1").withColumn("kind", kind).select(*key, "facts", "values", "least", "greatest", "kind", (kind != "rounding").alias("material"))


def ratio(over: Column, under: Column, alike: dict[str, Column] | None = None) -> Column:
    """A struct of `value` (a decimal, six places) and `guard`, the first reason why there is none.

    `alike` names conditions, such as one basis or one currency, that must hold.
    """
    refused = [(~F.coalesce(ok, F.lit(False)), f"unlike_{name}") for name, ok in (alike or {}).items()]
    checks = [*refused, (over.isNull() | under.isNull(), "missing"), (under == 0, "zero_denominator")]
    guard = reduce(lambda w, c: w.when(c[0], c[1]), checks[1:], F.when(checks[0][0], checks[0][1]))
    return F.struct(F.when(guard.isNull(), F.round(F.try_divide(over, under), 6).try_cast("decimal(38,6)")).alias("value"), guard.alias("guard"))


def growth(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """Each period with `previous`, `growth` (a share of the previous amount) and `guard`, the first reason why there is none.

    `period` counts up by one. Rows are one for each key and period.
    """
    w = Window.partitionBy(*by).orderBy(period)
    rows = series.withColumn("previous", F.lag(value).over(w)).withColumn("__before", F.lag(period).over(w))
    now, then = F.col(value), F.col("previous")
    first = F.when(F.col("__before").isNull(), "no_previous").when(F.col(period) - F.col("__before") != 1, "period_gap")
    guard = first.when(now.isNull() | then.isNull(), "missing").when(then == 0, "zero_base").when(F.signum(now.cast("double")) * F.signum(then.cast("double")) < 0, "sign_change")
    # in millionths, so that the quotient is rounded once
    million = F.lit(1_000_000).cast("decimal(7,0)")
    share = F.try_divide(F.round(F.try_divide(F.try_multiply(now - then, million), F.abs(then)), 0), million).try_cast("decimal(38,6)")
    return rows.withColumn("guard", guard).withColumn("growth", F.when(F.col("guard").isNull(), share)).drop("__before")


def compound_growth(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """One row a key: its first and last period with their values, `cagr` a period, and `guard`."""
    ends = series.groupBy(*by).agg(F.min(F.struct(period, value)).alias("a"), F.max(F.struct(period, value)).alias("z"))
    own = ends.select(*by, F.col(f"a.{period}").alias("first"), F.col(f"z.{period}").alias("last"), F.col(f"a.{value}").alias("opening"), F.col(f"z.{value}").alias("closing"))
    guard = F.when(F.col("opening").isNull() | F.col("closing").isNull(), "missing").when(F.col("first") == F.col("last"), "one_period").when((F.col("opening") <= 0) | (F.col("closing") <= 0), "not_positive")
    rate = F.pow(F.col("closing").cast("double") / F.col("opening").cast("double"), 1.0 / (F.col("last") - F.col("first")).cast("double")) - 1.0
    return own.withColumn("guard", guard).withColumn("cagr", F.when(F.col("guard").isNull(), F.round(rate, 9)))
