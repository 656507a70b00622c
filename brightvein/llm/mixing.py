"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every source gets a target number of words; a document of it is due
target / source_size copies. The whole part is given; the fraction is rounded
by pivotal dependent rounding: two fractions meet, one moves to 0 or 1 and the
other keeps the rest, each with the chance that leaves its expectation as it
was. Blocks of documents of like size are settled side by side, each leaving at
most one fraction; those residuals meet in the next level, up to the source: a
reduction tree whose levels are written tables. Like sizes meet first, so the
words taken stay close to the target and not just the number of documents.

Defined results: a null text has size 0 and is taken 0 times; the null source
is a source of its own, ordered last; repeated rows are rounded as separate
documents; an empty table gives an empty result. Chances come from a hash of
the seed and of the two documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, discard, materialise, small, text_of

WEIGHTS = (5, 2, 1)
#: Documents a block holds on average.
BLOCK = 128
#: Size classes per doubling of the size, level by level; 0: one class a source.
FINENESS = (8, 1, 0)
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`source`, `source_size`, `target`: `share` of all sizes dealt out by weight, no source above `most` times its size.

    The level at which uncapped sources stand is found by repeated sums over the
    sources (one row to the driver each time); every round caps at least one
    more source, and few rounds are needed.
    """
    if most < share:
        raise ValueError("the sources can't hold so much")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = materialise(per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "sources")
    first = per.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total = share * (first["s"] or 0)
    level = total / first["w"] if first["w"] else 0.0
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("cap")
        row = per.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new = (total - row["c"]) / row["w"] if row["w"] else level
        if new <= level:
            break
        level = new
    return per.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


_ITEM = "struct<size:bigint,doc_id:bigint,base:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,copies:bigint>>"


def _settle(seed: int, level: int) -> Column:
    """The fold over a block's sorted `items`: struct of the carried fraction `c` (or null) and the settled `out`."""
    u = f"(shiftrightunsigned(xxhash64({seed}L, {level}, size(acc.out), acc.c.doc_id, acc.c.size, x.doc_id, x.size), 11) / 9007199254740992D)"
    s = "(acc.c.p + x.p)"
    low = f"({s} < 1D)"
    #: whether the carried one is the one that is settled now
    first = f"CASE WHEN {low} THEN {u} >= acc.c.p / {s} ELSE {u} < (1D - x.p) / (2D - {s}) END"
    gain = f"CASE WHEN {low} THEN 0L ELSE 1L END"
    rest = f"CASE WHEN {low} THEN {s} ELSE {s} - 1D END"
    kept = lambda y: f"named_struct('size', {y}.size, 'doc_id', {y}.doc_id, 'base', {y}.base, 'p', {rest})"
    done = lambda y: f"named_struct('doc_id', {y}.doc_id, 'size', {y}.size, 'copies', {y}.base + {gain})"
    ended = lambda y: f"named_struct('doc_id', {y}.doc_id, 'size', {y}.size, 'copies', {y}.base + CAST(round({rest}) AS BIGINT))"
    over = f"(abs({rest} - round({rest})) < {EPS!r}D)"
    none = f"CAST(NULL AS {_ITEM})"
    step = f"""CASE WHEN acc.c IS NULL THEN named_struct('c', x, 'out', acc.out)
      WHEN {first} THEN named_struct('c', CASE WHEN {over} THEN {none} ELSE {kept('x')} END, 'out', CASE WHEN {over} THEN concat(acc.out, array({done('acc.c')}, {ended('x')})) ELSE concat(acc.out, array({done('acc.c')})) END)
      ELSE named_struct('c', CASE WHEN {over} THEN {none} ELSE {kept('acc.c')} END, 'out', CASE WHEN {over} THEN concat(acc.out, array({done('x')}, {ended('acc.c')})) ELSE concat(acc.out, array({done('x')})) END) END"""
    return F.expr(f"aggregate(items, named_struct('c', {none}, 'out', CAST(array() AS {_DONE})), (acc, x) -> {step})")


def _repeated(alike: DataFrame, times: Column, copies: Column) -> DataFrame:
    """Each row `times` times, made in arrays of bounded length."""
    rows = alike.select("source", "doc_id", "size", copies.cast("long").alias("copies"), times.cast("long").alias("times")).filter("times > 0")
    rows = rows.withColumn("chunk", F.explode(F.expr("sequence(0L, (times - 1) DIV 4096)")))
    return rows.select("source", "doc_id", "size", "copies", F.explode(F.expr("sequence(1L, least(4096L, times - chunk * 4096L))")).alias("nth")).drop("nth")


def pivotal_copies(due: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Round `copies_due` (with `source`, `doc_id`, `size`) to whole `copies`; one row out for each row in."""
    whole = F.floor(F.col("copies_due") + EPS)
    # rows that share source, id and size are alike: their fractions meet each other first, which leaves whole rows and one fraction at most
    alike = due.groupBy("source", "doc_id", "size", "copies_due").agg(F.count("*").alias("rows"))
    alike = alike.withColumn("base", whole.cast("long")).withColumn("p", F.greatest(F.col("copies_due") - whole, F.lit(0.0)))
    alike = alike.withColumn("up", F.floor(F.col("rows") * F.col("p") + EPS).cast("long")).withColumn("left", F.greatest(F.col("rows") * F.col("p") - F.col("up"), F.lit(0.0)))
    alike = alike.withColumn("left", F.when(F.col("left") > EPS, F.col("left")).otherwise(0.0))
    alike = materialise(alike, "alike")
    several = alike.filter("rows > 1")
    settled = [_repeated(several, F.col("up"), F.col("base") + 1), _repeated(several, F.col("rows") - F.col("up") - (F.col("left") > 0).cast("long"), F.col("base"))]
    rows = alike.filter("rows = 1 OR left > 0").withColumn("p", F.when(F.col("rows") > 1, F.col("left")).otherwise(F.col("p")))
    settled += [rows.filter(f"size = 0 OR p <= {EPS!r}D").select("source", "doc_id", "size", "base").withColumnRenamed("base", "copies")]
    left = rows.filter(f"size > 0 AND p > {EPS!r}D").select("source", "doc_id", "size", "base", "p")
    level = 0
    while True:
        fine = FINENESS[min(level, len(FINENESS) - 1)]
        left = left.withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * fine).cast("int") if fine else F.lit(0))
        counts = materialise(left.groupBy("source", "class").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")), "blocks")
        most = counts.agg(F.max("blocks").alias("m"), F.count("*").alias("n")).first()
        by = small(counts.select(F.col("source").alias("s2"), F.col("class").alias("c2"), "blocks"), 100_000)
        placed = left.join(by, F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")))
        placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.col("blocks")))
        items = placed.groupBy("source", "class", "block").agg(F.array_sort(F.collect_list(F.struct("size", "doc_id", "base", "p"))).alias("items"))
        done = materialise(items.select("source", _settle(seed, level).alias("r")), f"level{level}")
        settled.append(done.select("source", F.inline("r.out")).select("source", "doc_id", "size", "copies"))
        left = done.filter("r.c IS NOT NULL").select("source", "r.c.doc_id", "r.c.size", "r.c.base", "r.c.p")
        discard(counts)
        if not fine and (most["m"] or 0) <= 1:
            break
        level += 1
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("last"), "doc_id", "size"), 11) / F.lit(float(1 << 53))
    settled.append(left.select("source", "doc_id", "size", (F.col("base") + (chance < F.col("p")).cast("long")).alias("copies")))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """`doc_id`, `source`, `size`, `source_size`, `target`, `copies`: one row for each row of `docs`."""
    size = F.regexp_count(text_of(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long")
    sizes = materialise(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size")), "sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    by = small(targets.withColumnRenamed("source", "s1"), 100_000)
    match = F.col("source").eqNullSafe(F.col("s1"))
    due = sizes.join(by, match).select("source", "doc_id", "size", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies_due"))
    copies = pivotal_copies(due, seed)
    return copies.join(by, match).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: what a pipeline stage needs.

    Rows that share id, source and size are told apart by their order by text.
    Rows and their copies meet in one exchange of the rows: for each key there
    are as many of either, so sorted by number each row follows its copies.
    """
    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{source_col}`").alias("s"), F.regexp_count(text_of(F.col(f"`{text_col}`")), F.lit(WORD)).cast("long").alias("n"))
    own = docs.select(F.xxhash64(key).alias("key"), F.lit(None).cast("long").alias("copies"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = mix(docs, id_col, text_col, source_col, seed=seed).select(F.xxhash64(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n"))).alias("key"), "copies", F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    both = own.unionByName(taken).withColumn("is_row", F.col("row").isNotNull()).repartition("key")
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy("key", "is_row").orderBy(F.col("row")[text_col], F.desc("copies"))))
    both = both.withColumn("due", F.lag("copies").over(Window.partitionBy("key").orderBy("nth", "is_row"))).filter("is_row AND due > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("due").cast("int")))).select("row.*")


def op7_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")
