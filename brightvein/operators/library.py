"""What is in the library: its listing, censuses of its texts, and contracts of what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis
from .retrieval import sized_broadcast

#: Element types that the listing counts, with their names there, and verdicts on tables.
COUNTED = {"page": "pages", "block": "blocks", "table": "tables", "footnote": "footnotes"}
VERDICTS = ("accepted", "rejected")


def library(versions: DataFrame, elements: DataFrame, tables: DataFrame, chunks: DataFrame, limit: int = 500) -> DataFrame:
    """The newest `limit` versions with what they hold: elements by type, unreadable ones, tables by verdict, chunks by role and their median size, the run's seconds.

    `versions` has `version_id`, `created_at`, `run_id`, `generation_id` and the
    run's `started_at` and `completed_at`; elements `run_id`, `element_type` and
    `failure_reason`; tables `run_id` and `verdict`; chunks `generation_id`,
    `role` and `tokens`. Only what belongs to a listed version's own run and
    generation is counted, and each table is summed up before it is joined.
    """
    shown = versions.orderBy(F.desc("created_at"), "version_id").limit(limit)
    of_runs = lambda df: df.join(F.broadcast(shown.select("run_id").distinct()), "run_id", "left_semi")
    kinds = of_runs(elements).groupBy("run_id").agg(*(F.count_if(F.col("element_type") == k).alias(n) for k, n in COUNTED.items()), F.count_if(F.col("failure_reason").isNotNull()).alias("unreadable_regions"))
    judged = of_runs(tables).groupBy("run_id").agg(*(F.count_if(F.col("verdict") == v).alias(f"tables_{v}") for v in VERDICTS))
    own = chunks.join(F.broadcast(shown.select("generation_id").distinct()), "generation_id", "left_semi")
    child = F.col("role") == "child"
    # the median from counts of sizes, so that no generation's chunks meet in one task
    sizes = own.groupBy("generation_id", "role", "tokens").agg(F.count("*").alias("n"))
    held = sizes.groupBy("generation_id").agg(F.sum("n").alias("chunks"), F.sum(F.when(child, F.col("n")).otherwise(0)).alias("child_chunks"), F.sum(F.when(F.col("role") == "parent", F.col("n")).otherwise(0)).alias("parent_chunks"))
    middle = median_of_counts(sizes.filter(child), ["generation_id"], "tokens", "n", "median_child_tokens")
    out = shown.join(kinds, "run_id", "left").join(judged, "run_id", "left").join(held, "generation_id", "left").join(middle, "generation_id", "left")
    counts = [*COUNTED.values(), "unreadable_regions", *(f"tables_{v}" for v in VERDICTS), "chunks", "child_chunks", "parent_chunks", "median_child_tokens"]
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000
    rest = [c for c in versions.columns if c not in ("started_at", "completed_at")]
    return out.select(*rest, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), seconds.alias("extraction_seconds")).orderBy(F.desc("created_at"), "version_id")


def median_of_counts(counts: DataFrame, by: list[str], value: str, n: str, name: str) -> DataFrame:
    """The interpolated median of values that come with how often they are there, as a whole number, halves to the even one."""
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("__to", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(n).over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor((F.col("__all") + 2) / 2)
    at = lambda place: F.min(F.when(F.col("__to") >= place, F.col(value)))
    return upto.groupBy(*by).agg(F.rint((at(low) + at(high)) / 2).cast("long").alias(name))


def per_generation(chunks: DataFrame, events: DataFrame, key: str = "generation_id") -> DataFrame:
    """`key`, `children`, `parents`, `queued`, `completed`: chunks and outbox events of each generation that has either."""
    own = chunks.groupBy(key).agg(F.count_if(F.col("role") == "child").alias("children"), F.count_if(F.col("role") == "parent").alias("parents"))
    told = events.groupBy(key).agg(F.count("*").alias("queued"), F.count_if(F.col("state") == "completed").alias("completed"))
    return own.join(told, key, "full").fillna(0, ["children", "parents", "queued", "completed"])


def census(texts: DataFrame, probes: dict[str, str], by: list[str] | None = None, text: str = "text") -> DataFrame:
    """`probe`, `n`, `of`, `share`: how many texts each pattern is found in, in one pass."""
    by = by or []
    counted = texts.groupBy(*by).agg(F.count(text).alias("of"), *(F.count_if(F.col(text).rlike(p)).alias(f"p{i}") for i, p in enumerate(probes.values())))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("probe"), F.col(f"p{i}").alias("n")) for i, name in enumerate(probes)))).alias("x")
    return counted.select(*by, "of", each).select(*by, "x.probe", "x.n", "of", F.try_divide("x.n", "of").alias("share"))


def reachable(texts: DataFrame, words: list[str], text: str = "text", config: str = "simple") -> DataFrame:
    """`word`, `texts`: how many texts a search for each probe word would reach, none included."""
    spark = texts.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "word string").select("word", F.element_at(analysis.analysed(F.col("word"), config), 1).alias("term"))
    found = texts.select(F.explode(F.array_distinct(analysis.analysed(F.col(text), config))).alias("term")).join(sized_broadcast(asked.select("term").distinct(), 10_000), "term").groupBy("term").agg(F.count("*").alias("texts"))
    return asked.join(found, "term", "left").select("word", F.coalesce("texts", F.lit(0)).alias("texts"))


def characters(texts: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """`char`, `n`: the `k` most frequent characters beyond ASCII."""
    each = F.explode(F.split(F.regexp_replace(text, r"[\x00-\x7F]", ""), "")).alias("char")
    return texts.select(each).filter("char <> ''").groupBy("char").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "char").limit(k)


def with_sections(blocks: DataFrame, by: list[str], order: str, heading: Column, name: str = "section") -> DataFrame:
    """Blocks with the number of their section: a heading begins the next one, and what comes before the first is in section 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn(name, F.sum(F.coalesce(heading, F.lit(False)).cast("int")).over(w))


def tree_size(elements: DataFrame, by: list[str]) -> DataFrame:
    """`nodes`, `leaves` and `depth` of each tree; elements have `element_id`, `parent_id` and `depth`."""
    inner = elements.filter("parent_id IS NOT NULL").select(*by, F.col("parent_id").alias("element_id")).distinct().withColumn("__inner", F.lit(True))
    own = elements.join(inner, [*by, "element_id"], "left")
    return own.groupBy(*by).agg(F.count("*").alias("nodes"), F.count_if(F.col("__inner").isNull()).alias("leaves"), F.max("depth").alias("depth"))


def joined_text(words: DataFrame, by: list[str]) -> DataFrame:
    """`by`, `line`: words (`text`, `x0`, `y0`) down the page by their height to a tenth, then across."""
    parts = F.array_sort(F.collect_list(F.struct(F.bround("y0", 1).alias("y"), F.col("x0").alias("x"), F.col("text").alias("t"))))
    return words.filter("text <> ''").groupBy(*by).agg(F.array_join(F.transform(parts, lambda w: w["t"]), " ").alias("line"))


def broken_grids(cells: DataFrame, shapes: DataFrame, by: list[str]) -> DataFrame:
    """`by`, `fault`: grids whose cells (`r`, `c`) don't fill their shape (`rows`, `columns`) once each: outside, repeated or missing."""
    both = cells.select(*by, "r", "c").join(shapes.select(*by, "rows", "columns"), by)
    outside = (F.col("r") < 0) | (F.col("c") < 0) | (F.col("r") >= F.col("rows")) | (F.col("c") >= F.col("columns"))
    per = both.groupBy(*by, "rows", "columns", "r", "c").agg(F.count("*").alias("n")).groupBy(*by, "rows", "columns").agg(F.bool_or(outside).alias("o"), F.max("n").alias("most"), F.count("*").alias("places"))
    fault = F.when(F.col("o"), "outside").when(F.col("most") > 1, "repeated").when(F.col("places") < F.col("rows") * F.col("columns"), "missing")
    return per.select(*by, fault.alias("fault")).filter("fault IS NOT NULL")


def detectors(regions: DataFrame, truth: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """`detector`, `scored`, `hits`, `area_share`: pages with a number of tables known (`real_tables`, a text that may be no number), on how many the detector found as many, and the share of their area its regions take.

    Regions have `by`, `detector`, `x0` to `y1`; pages `by`, `width`, `height`.
    A page without a region counts for every detector.
    """
    known = truth.select(*by, F.expr("try_cast(real_tables AS int)").alias("real")).filter("real IS NOT NULL").join(pages, by)
    names = [r[0] for r in regions.select("detector").distinct().limit(1_000).collect()]
    asked = known.select("*", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("detector"))
    found = regions.groupBy(*by, "detector").agg(F.count("*").alias("n"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    own = asked.join(found, [*by, "detector"], "left").fillna(0, ["n", "area"])
    return own.groupBy("detector").agg(F.count("*").alias("scored"), F.count_if(F.col("n") == F.col("real")).alias("hits"), F.try_divide(F.sum("area"), F.sum(F.col("width") * F.col("height"))).alias("area_share"))
