"""Writes of what the engine makes: element trees, chunks with their outbox, cached vectors, points, audits, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import insert_missing
from ..operators.retrieval import sized_broadcast


def flattened(pages: DataFrame, children: str = "children") -> DataFrame:
    """Elements of page trees, a level after the other: `element_id`, `parent_id`, `ordinal`, `depth` and the element's own fields.

    `pages` has `run_id` and `element`, a struct whose field `children` is an
    array of such structs without that field at the lowest level. Ids are
    derived from the run and the path of ordinals, so reruns give the same.
    """
    now = pages.select("run_id", F.lit(None).cast("string").alias("parent_id"), F.col("ordinal").cast("int").alias("ordinal"), F.lit(0).alias("depth"), F.col("element").alias("e"))
    ident = F.sha2(F.concat_ws("/", "run_id", F.coalesce("parent_id", F.lit("")), F.col("ordinal").cast("string")), 256)
    out = None
    while True:
        now = now.withColumn("element_id", ident)
        fields = now.schema["e"].dataType.fieldNames()
        level = now.select("run_id", "element_id", "parent_id", "ordinal", "depth", *(F.col("e")[f].alias(f) for f in fields if f != children))
        out = level if out is None else out.unionByName(level, allowMissingColumns=True)
        if children not in fields:
            return out
        now = now.select("run_id", F.col("element_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.posexplode(F.col("e")[children]).alias("ordinal", "e"))


def _add(rows: DataFrame, path: str, key: list[str], part: str | None = None) -> None:
    """Append the rows whose key the table lacks, so that a repeated write adds what is missing and nothing else."""
    new = insert_missing(_read(rows.sparkSession, path, rows), rows, key).write.mode("append")
    (new.partitionBy(part) if part else new).parquet(path)


def record_elements(elements: DataFrame, path: str) -> int:
    """Write a run's flattened elements, and table and cell details to tables of their own; the number of elements.

    Rows go to `elements`, `tables` and `cells` under `path`, by run and
    element: what is there already is not written again.
    """
    shared = ["run_id", "element_id", "parent_id", "ordinal", "depth", "element_type", "text", "failure_reason", "page_number"]
    have = [c for c in shared if c in elements.columns]
    _add(elements.select(*have, F.length("text").alias("char_count")), f"{path}/elements", ["run_id", "element_id"], "run_id")
    for kind, columns in (("table", ("caption", "verdict", "verdict_reasons")), ("cell", ("row_index", "column_index", "header_path", "row_label_path", "is_header", "is_total", "units"))):
        own = [c for c in columns if c in elements.columns]
        if own:
            _add(elements.filter(F.col("element_type") == kind).select("run_id", "element_id", *own), f"{path}/{kind}s", ["run_id", "element_id"], "run_id")
    return elements.count()


def invalid_elements(elements: DataFrame) -> DataFrame:
    """Elements that break an invariant, with the rule: text or a failure but not both, and cells alone below tables."""
    rules = F.array_compact(F.array(
        F.when(F.col("text").isNotNull() == F.col("failure_reason").isNotNull(), "text_xor_failure"),
        F.when(F.col("depth") > 2, "too_deep"),
        F.when((F.col("depth") == 0) & (F.col("element_type") != "page"), "root_is_a_page"),
        F.when((F.col("depth") == 2) & ~F.col("element_type").isin("cell", "footnote"), "below_a_table"),
    ))
    return elements.select("element_id", F.explode(rules).alias("rule"))


def record_chunks(chunks: DataFrame, path: str, generation_id: str, version_id: str, config: str) -> None:
    """Chunks, their sources, and an outbox event for each child, under `path`.

    Parquet has no transaction over three tables. The outbox, which makes
    chunks visible to indexing, is written last, ids are derived from the
    generation and the place, and rows whose id is there are not written again:
    a write that broke off is simply repeated.
    """
    own = chunks.withColumn("chunk_id", F.sha2(F.concat_ws("/", F.lit(generation_id), F.col("doc_id").cast("string"), F.col("ordinal").cast("string")), 256))
    parent = F.when(F.col("parent").isNotNull(), F.sha2(F.concat_ws("/", F.lit(generation_id), F.col("doc_id").cast("string"), F.col("parent").cast("string")), 256))
    own = own.withColumn("parent_id", parent).withColumn("generation_id", F.lit(generation_id)).withColumn("document_version_id", F.lit(version_id)).withColumn("config_version", F.lit(config))
    _add(own.drop("element_ids", "parent"), f"{path}/chunks", ["generation_id", "chunk_id"], "generation_id")
    sources = own.select("generation_id", "chunk_id", F.posexplode(F.array_distinct("element_ids")).alias("position", "source_element_id"))
    _add(sources, f"{path}/chunk_sources", ["generation_id", "chunk_id", "position"], "generation_id")
    events = own.filter("role = 'child'").select("generation_id", "chunk_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))
    _add(events, f"{path}/outbox", ["generation_id", "chunk_id"], "generation_id")


def cache_vectors(rows: DataFrame, path: str, key: tuple[str, ...] = ("digest", "model", "config", "kind")) -> int:
    """Add the vectors whose key the cache lacks, the first of each; how many landed."""
    spark = rows.sparkSession
    new = insert_missing(_read(spark, path, rows), rows, list(key))
    before = _read(spark, path, rows).count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def touched(cache: DataFrame, used: DataFrame, key: list[str], at: str = "used_at") -> DataFrame:
    """The cache with the last use of each entry brought up to that in `used` (`key`, `at`); an entry is never set back."""
    last = used.groupBy(*key).agg(F.max(at).alias("__at"))
    return cache.join(last, key, "left").withColumn(at, F.greatest(at, "__at")).drop("__at").select(*cache.columns)


def unused_since(cache: DataFrame, cutoff, at: str = "used_at") -> DataFrame:
    """The entries that pruning at a cutoff removes."""
    return cache.filter(F.col(at) < F.lit(cutoff))


def prune_cache(spark: SparkSession, path: str, cutoff, at: str = "used_at") -> int:
    """Writes the entries used since `cutoff` beside the cache and puts them in its place; how many went."""
    cache = spark.read.parquet(path)
    gone = unused_since(cache, cutoff, at).count()
    if gone:
        cache.filter(F.col(at).isNull() | (F.col(at) >= F.lit(cutoff))).write.mode("overwrite").parquet(f"{path}.new")
        jvm = spark.sparkContext._jvm
        old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
        fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)
        spark.catalog.refreshByPath(path)
    return gone


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(like.schema).parquet(path) if at.getFileSystem(conf).exists(at) else like.limit(0)


def ensure_index(spark: SparkSession, path: str, dimensions: int) -> None:
    """Refuse an index whose vectors have another length; one that isn't there yet is made by the first write."""
    like = spark.createDataFrame([], "generation_id string, chunk_id string, vector array<float>")
    found = _read(spark, path, like).select("vector").filter(F.size("vector") != dimensions).limit(1).count()
    if found:
        raise ValueError(f"the index at {path} holds vectors that don't have {dimensions} dimensions")


def upsert_points(points: DataFrame, path: str) -> int:
    """Add points (`generation_id`, `chunk_id`, `vector`, `terms`, `weights`, payload) that the index lacks; how many.

    A point is known by generation and chunk, so a redelivery changes nothing.
    Terms and weights of different lengths are refused.
    """
    if points.filter(F.size("terms") != F.size("weights")).limit(1).count():
        raise ValueError("terms and weights don't match")
    new = insert_missing(_read(points.sparkSession, path, points), points, ["generation_id", "chunk_id"])
    before = _read(points.sparkSession, path, points).count()
    new.write.mode("append").partitionBy("generation_id").parquet(path)
    return points.sparkSession.read.parquet(path).count() - before


def delete_generations(spark: SparkSession, path: str, gone: DataFrame) -> int:
    """Drop the points of these generations (`generation_id`); how many went, by counts before and after.

    Generations that have folders of their own lose these; an index without
    such folders is written anew, beside its place, without their points.
    """
    before = spark.read.parquet(path).count()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    folders = lambda: any(s.getPath().getName().startswith("generation_id=") for s in files.listStatus(at))
    if folders():
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in gone.toLocalIterator():
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/generation_id={escape(r['generation_id'])}"), True)
        spark.catalog.refreshByPath(path)
        return before - (spark.read.parquet(path).count() if folders() else 0)
    left = jvm.org.apache.hadoop.fs.Path(f"{path}-left")
    spark.read.parquet(path).join(sized_broadcast(gone.select("generation_id"), 1_000_000), "generation_id", "left_anti").write.mode("overwrite").parquet(f"{path}-left")
    if not (files.delete(at, True) and files.rename(left, at)):
        raise OSError(f"{path}-left could not take the place of {path}")
    spark.catalog.refreshByPath(path)
    return before - spark.read.parquet(path).count()


def record_answers(decisions: DataFrame, claims: DataFrame, path: str, key: str = "answer_id", claim: str = "claim_index") -> None:
    """Add decided answers, and their claims, under `path`, by their keys; an abstention that releases claims is refused."""
    if decisions.filter("(decision = 'abstained') <> (released = 0)").limit(1).count():
        raise ValueError("an answer is abstained from just when nothing is released")
    _add(claims, f"{path}/answer_claims", [c for c in (key, claim) if c in claims.columns])
    _add(decisions, f"{path}/answers", [key])


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
