"""Structure of detected tables: spans, row roles, header and label paths, units, quality.

A cell is a row of `table_id`, `r`, `c` (from 0), `text`, `present` (false where
a neighbour's span covers the position, or nothing was found), and optionally
`text_left`, `column_span`, `row_span` as reported. All work is partitioned by
table; the only fold is over one table's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Points of slack before a label counts as indented.
INDENT = 1.0
KEYS = ["table_id", "r", "c"]


def _bare() -> Column:
    return F.trim(F.col("text"))


def with_reported(cells: DataFrame) -> DataFrame:
    """Cells with the optional columns, null where the detector doesn't report them."""
    for name, kind in (("text_left", "double"), ("column_span", "int"), ("row_span", "int")):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast(kind))
    return cells


def with_spans(cells: DataFrame) -> DataFrame:
    """Spans of present cells: the reported one, else one more for each absent cell that follows; null for absent cells."""

    def reach(line: str, at: str, reported: str) -> Column:
        w = Window.partitionBy("table_id", line).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
        following = F.first(F.when(F.col("present"), F.col(at)), ignorenulls=True).over(w)
        end = F.max(at).over(Window.partitionBy("table_id")) + 1
        return F.when(F.col("present"), F.coalesce(F.col(reported), (F.coalesce(following, end) - F.col(at)).cast("int")))

    return with_reported(cells).withColumns({"column_span": reach("r", "c", "column_span"), "row_span": reach("c", "r", "row_span")})


def row_roles(cells: DataFrame) -> DataFrame:
    """One row a table row: `label`, `is_units`, `is_section`, `is_header`, `is_total`.

    Roles follow shape: a label alone opens a section; rows without a label,
    and the first, are headers until the first section or data row.
    """
    return _judged(cells.groupBy("table_id", "r").agg(*_shape(cells))).select("table_id", "r", "label", "indent", "is_units", "is_section", "is_header", "is_total")


def _shape(cells: DataFrame) -> list[Column]:
    """What the cells of a row tell of it."""
    first = F.col("c") == 0
    return [
        F.bool_or(X.states_units(F.col("text"))).alias("is_units"),
        F.bool_or(first & (_bare() != "")).alias("labelled"),
        F.bool_or(~first & (_bare() != "")).alias("beyond"),
        F.max(F.when(first, F.col("text"))).alias("raw"),
        F.max(F.when(first, F.col("text_left"))).alias("indent") if "text_left" in cells.columns else F.lit(None).cast("double").alias("indent"),
    ]


def _judged(shape: DataFrame) -> DataFrame:
    """Rows with their shape, label and roles."""
    rows = Window.partitionBy("table_id")
    above = rows.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    section = ~F.col("is_units") & F.col("labelled") & ~F.col("beyond")
    like_header = ((F.col("r") == 0) & (F.count("*").over(rows) > 1)) | (~F.col("labelled") & F.col("beyond"))
    out = shape.withColumn("is_section", section).withColumn("__like", like_header)
    out = out.withColumn("__stop", ~F.col("is_units") & (F.col("is_section") | ~F.col("__like")))
    stopped = F.coalesce(F.bool_or("__stop").over(above), F.lit(False))
    out = out.withColumn("is_header", ~F.col("is_units") & ~F.col("is_section") & F.col("__like") & ~stopped)
    out = out.withColumn("label", X.without_marker(F.coalesce("raw", F.lit(""))))
    total = ~F.col("is_header") & ~F.col("is_units") & X.total_word(F.col("label")).isNotNull()
    return out.withColumn("is_total", total)


def _named(value: Column, f) -> Column:
    """`f` of a value that is worked out once, however often `f` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _texts(rows: Column, role: str, also=lambda t: F.lit(True)) -> Column:
    """The cells with a text in a table's rows of a role, from the top and the left: `c`, `t` and the column `end` that they reach to."""
    cell = lambda x: F.struct(x["c"].alias("c"), F.trim(x["text"]).alias("t"), (x["c"] + x["column_span"]).alias("end"))
    own = F.flatten(F.transform(F.filter(rows, lambda r: r[role]), lambda r: F.transform(F.filter(r["cells"], lambda x: x["present"]), cell)))
    return F.filter(own, lambda x: (x["t"] != "") & also(x["t"]))


def _over(texts: Column, c: Column) -> Column:
    """Of such texts those that reach over a column."""
    return F.transform(F.filter(texts, lambda x: (x["c"] <= c) & (c < x["end"])), lambda x: x["t"])


def _label_paths(rows: Column) -> Column:
    """For each row of a table its path, of section and labels nested by indent; null for rows without a label, headers and units."""
    stack = "array<struct<i:double,t:string>>"
    nothing = F.array().cast(stack)
    start = F.struct(F.lit(None).cast("string").alias("s"), nothing.alias("k"), F.array().cast("array<array<string>>").alias("o"))

    def step(a, x):
        own = F.struct(x["indent"].alias("i"), x["label"].alias("t"))
        nested = F.concat(F.filter(a["k"], lambda y: y["i"] < x["indent"] - INDENT), F.array(own))
        k = F.when(x["is_section"], nothing).when(x["indent"].isNull(), F.array(F.struct(F.lit(0.0).alias("i"), x["label"].alias("t")))).otherwise(nested)
        state = F.struct(F.when(x["is_section"], x["label"]).otherwise(a["s"]).alias("s"), k.cast(stack).alias("k"))
        path = lambda n: F.concat(F.when(n["s"].isNull(), F.array().cast("array<string>")).otherwise(F.array(n["s"])), F.transform(n["k"], lambda y: y["t"]))
        pushed = _named(state, lambda n: F.struct(n["s"].alias("s"), n["k"].alias("k"), F.concat(a["o"], F.array(path(n))).alias("o")))
        passed = F.struct(a["s"].alias("s"), a["k"].alias("k"), F.concat(a["o"], F.array(F.lit(None).cast("array<string>"))).alias("o"))
        return F.when(x["is_header"] | x["is_units"] | (x["label"] == ""), passed).otherwise(pushed)

    return F.aggregate(rows, start, step, lambda a: a["o"])


def derive(cells: DataFrame) -> DataFrame:
    """Cells with spans, roles of their rows, header and label paths, footnote marker and the units that govern them.

    Everything is partitioned by table, so cells are shuffled once at most. A
    table's rows meet in one row, which tells what reaches over them: texts of
    header rows, outermost first; units, of the whole table in the label column
    or of single columns, of which the last ones hold; and label paths, which
    rows under a spanning label share.
    """
    spanned = with_spans(cells)
    cell = F.struct("c", "text", "present", "row_span", "column_span")
    rows = _judged(spanned.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max(F.when(F.col("c") == 0, F.struct("present", "row_span"))).alias("head"), *_shape(spanned)))
    order = Window.partitionBy("table_id").orderBy("r")
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    holder = F.last(F.when(F.col("head.present"), F.struct("r", "head.row_span", "at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__h", holder).withColumn("owner", F.when(F.col("head").isNotNull() & (F.col("r") < F.col("__h.r") + F.col("__h.row_span")), F.col("__h.at")))
    whole = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "cells", "label", "indent", "is_units", "is_section", "is_header", "is_total", "owner"))).alias("rows"))
    none = F.array().cast("array<string>")

    def out(rows):
        columns = F.sequence(F.lit(0), F.array_max(F.flatten(F.transform(rows, lambda r: F.transform(r["cells"], lambda x: x["c"])))))
        texts = F.struct(_texts(rows, "is_header").alias("heads"), _texts(rows, "is_units", X.states_units).alias("units"))
        over = lambda t: F.struct(
            F.transform(columns, lambda c: _over(t["heads"], c)).alias("heads"),
            F.transform(columns, lambda c: F.when(c > 0, F.try_element_at(_over(F.filter(t["units"], lambda x: x["c"] > 0), c), F.lit(-1)))).alias("units"),
            F.try_element_at(F.filter(t["units"], lambda x: x["c"] == 0), F.lit(-1))["t"].alias("all"),
        )
        told = F.struct(_named(texts, over).alias("over"), _label_paths(rows).alias("paths"))
        return _named(told, lambda m: F.flatten(F.transform(rows, lambda r: F.transform(r["cells"], lambda x: full(r, x, m["over"], m["paths"])))))

    def full(r, x, over, paths):
        return F.struct(
            r["r"].alias("r"), *(x[n].alias(n) for n in ("c", "text", "present", "row_span", "column_span")), r["is_header"].alias("is_header"), r["is_total"].alias("is_total"),
            F.when(r["is_header"], none).otherwise(F.get(over["heads"], x["c"].cast("int"))).alias("header_path"),
            F.when(r["is_header"] | (x["c"] == 0), none).otherwise(F.coalesce(F.get(paths, r["owner"].cast("int")), none)).alias("row_label_path"),
            F.when(~r["is_header"] & ~r["is_units"], F.coalesce(F.get(over["units"], x["c"].cast("int")), over["all"])).alias("units"),
        )

    made = whole.select("table_id", F.inline(_named(F.col("rows"), out)))
    return made.select(*KEYS, "text", "present", "row_span", "column_span", "is_header", "is_total", "header_path", "row_label_path", X.footnote_marker(F.col("text")).alias("footnote"), "units")


def assess(derived: DataFrame) -> DataFrame:
    """One row a table: shares of prose, numerals and filled cells, and the verdict; `usable` only if accepted."""
    filled = F.col("present") & (_bare() != "")
    body = F.col("present") & ~F.col("is_header")
    chars = lambda also: F.coalesce(F.sum(F.when(filled & also, F.length("text"))), F.lit(0))
    share = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    got = derived.groupBy("table_id").agg(
        (F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"), F.count_if(filled).alias("texts"),
        share(chars(X.is_prose(F.col("text"))), chars(F.lit(True))).alias("prose_ratio"),
        share(F.count_if(body & X.looks_numeric(F.col("text"))), F.count_if(body)).alias("numeric_ratio"),
        share(F.count_if(filled), F.count_if(F.col("present"))).alias("filled_ratio"),
    )
    bad = (F.col("texts") == 0) | (F.col("rows") < 2) | (F.col("columns") < 2) | (F.col("prose_ratio") >= 1.0)
    return got.withColumn("verdict", F.when(bad, "rejected").otherwise("accepted")).withColumn("usable", ~bad)


def row_groups(rows: DataFrame, header: DataFrame, by: list[str], index: str, text: str = "text", limit: int = 1500) -> DataFrame:
    """Tables' rows in groups of at most `limit` characters that each begin with the header: `by`, `group`, `first_row`, `last_row`, `text`.

    Rows are numbered from 0 without gaps by `index`; `header` has `by` and
    `header`. A group has as many rows as surely fit beside the header if all
    were as long as the table's longest, and at least one, so a row's group is
    told by its number alone: no table is walked through, however long it is.
    """
    longest = rows.groupBy(*by).agg(F.max(F.length(text)).alias("__most"))
    fits = F.greatest(F.lit(1), F.floor((F.lit(limit) - F.length("header")) / (F.col("__most") + 1)))
    sized = header.join(longest, by).select(*by, "header", fits.cast("long").alias("__fits"))
    own = rows.join(sized, by).withColumn("group", F.floor(F.col(index) / F.col("__fits")))
    made = own.groupBy(*by, "group").agg(F.min(index).alias("first_row"), F.max(index).alias("last_row"), F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("rs"))
    return made.select(*by, "group", "first_row", "last_row", F.concat_ws("\n", "header", F.array_join(F.transform("rs", lambda r: r["t"]), "\n")).alias("text"))
