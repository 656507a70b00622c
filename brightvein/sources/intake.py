"""Files on their way in: integrity, type agreement, a content-addressed store, and version rows; and the manifest's rules."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import corpus

#: Types that may come in, and those a signature alone can't tell from their container's.
ALLOWED = ("application/pdf", "text/html", "application/xml", "text/plain", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
CONTAINERS = {"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "application/zip"}
HELD_OUT = "held_out"


def received(spark: SparkSession, path: str, most: int = 1 << 30, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row a file: its digest, size, types and `rejected`, the first reason against it, or null.

    Empty and over-long files are told, not dropped; the bytes of the latter are
    not read (the bound on the length reaches the file listing), whatever their size. The declared type must be allowed, and agree with the signature
    where there is one.
    """
    every = spark.read.format("binaryFile").load(path)
    long = every.filter(F.col("length") > most).select("path", "length", F.lit(None).cast("binary").alias("content"))
    found = every.filter(F.col("length") <= most).select("path", "length", "content").unionByName(long).unionByName(_empty(spark, path))
    detected, declared = corpus.sniffed(F.col("content")), corpus.media_type(F.col("path"))
    agrees = detected.isNull() | (detected == declared)
    for kind, holder in CONTAINERS.items():
        agrees = agrees | ((declared == kind) & (detected == holder))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too_large").when(declared.isNull(), "unknown_type").when(~declared.isin(*allowed), "type_not_allowed").when(~agrees, "type_disagrees")
    fits = (F.col("length") > 0) & (F.col("length") <= most)
    return found.select("path", F.col("length").alias("byte_size"), F.when(fits, F.sha2("content", 256)).alias("content_hash"), detected.alias("detected_content_type"), declared.alias("declared_content_type"), X.sanitised_filename(F.col("path")).alias("original_filename"), reason.alias("rejected"))


def _empty(spark: SparkSession, path: str) -> DataFrame:
    """The files without a byte under `path`, which Spark's reader leaves out."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [s for s in fs.listStatus(at) if s.isFile() and s.getLen() == 0]
    return spark.createDataFrame([(s.getPath().toString(), 0, b"") for s in listed], "path string, length long, content binary")


def intake(spark: SparkSession, path: str, store: str, versions: DataFrame, most: int = 1 << 30) -> DataFrame:
    """New version rows for the sound files under `path`, whose bytes are then in `store`; one for each content not known yet.

    `versions` has `content_hash`.
    """
    sound = received(spark, path, most).filter("rejected IS NULL")
    new = sound.groupBy("content_hash").agg(F.min(F.struct("path", "byte_size", "detected_content_type", "declared_content_type", "original_filename")).alias("f")).join(versions.select("content_hash"), "content_hash", "left_anti")
    rows = new.select("content_hash", "f.*", X.object_key(F.col("content_hash")).alias("object_key"))
    kept = put_if_absent(rows.select("path", "object_key", "byte_size"), store)
    return rows.join(kept, "object_key").select(F.sha2(F.concat(F.lit("version:"), "content_hash"), 256).alias("version_id"), "content_hash", "byte_size", "detected_content_type", "declared_content_type", "original_filename", "object_key", F.lit("received").alias("state"))


def put_if_absent(rows: DataFrame, store: str) -> DataFrame:
    """Copy each `path` to its `object_key` under `store` unless it is there: `object_key`, `added`.

    A copy is written beside its place and moved there whole. An object of
    another size under the key is an error. Each task copies its own files, so
    paths and store must be seen by all executors.
    """

    def work(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        for b in batches:
            out = []
            for path, key, size in zip(b["path"], b["object_key"], b["byte_size"]):
                source, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                target, root = fs.FileSystem.from_uri(store)
                place = posixpath.join(root, key)
                there = target.get_file_info(place)
                if there.type == fs.FileType.File:
                    if there.size != size:
                        raise ValueError(f"{key} is there with {there.size} bytes, not {size}")
                    out.append((key, False))
                    continue
                target.create_dir(posixpath.dirname(place), recursive=True)
                beside = f"{place}.{uuid.uuid4().hex}"
                with source.open_input_stream(at) as a, target.open_output_stream(beside) as z:
                    while part := a.read(1 << 20):
                        z.write(part)
                target.move(beside, place)
                out.append((key, True))
            yield pd.DataFrame(out, columns=["object_key", "added"])

    return rows.mapInPandas(work, "object_key string, added boolean")


def stored_objects(spark: SparkSession, store: str, keys: DataFrame) -> DataFrame:
    """`object_key`, `exists`, `byte_size`, `modified_at`: what the store says of each key, without reading any object."""
    root = F.regexp_replace(F.lit(store.rstrip("/")), "^[a-z]+:/*", "/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("p"), "length", "modificationTime")
    own = listed.withColumn("root", root).select(F.expr("substring(p, length(root) + 2)").alias("object_key"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified_at"))
    return keys.select("object_key").distinct().join(own, "object_key", "left").select("object_key", F.col("byte_size").isNotNull().alias("exists"), "byte_size", "modified_at")


def opened(store: str, keys: DataFrame, part: int = 1 << 20) -> DataFrame:
    """`object_key`, `at`, `data`: the objects' bytes in parts of at most `part`, read by the tasks; a key that isn't there is an error."""

    def work(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for key in b.column(0).to_pylist():
                source, root = fs.FileSystem.from_uri(store)
                at = 0
                with source.open_input_stream(posixpath.join(root, key)) as f:
                    while (data := f.read(part)) or not at:
                        yield pa.RecordBatch.from_pydict({"object_key": [key], "at": [at], "data": [bytes(data)]})
                        if not data:
                            break
                        at += len(data)

    return keys.select("object_key").mapInArrow(work, "object_key string, at long, data binary")


def verified(spark: SparkSession, entries: DataFrame, root: str, unseal: bool = False) -> DataFrame:
    """Entries (`entry_id`, `split`, `path`, `content_hash`, `byte_size`) with `fault`: missing, size or digest; null if intact.

    Held-out entries are refused unless unsealed, before any file is read.
    """
    if not unseal and entries.filter(F.col("split") == HELD_OUT).limit(1).count():
        raise PermissionError("held-out files are not read")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    own = found.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^"), base, F.lit("/")), "").alias("path"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_hash"))
    fault = F.when(F.col("found_hash").isNull(), "missing").when(F.col("found_size") != F.col("byte_size"), "size").when(F.col("found_hash") != F.col("content_hash"), "digest")
    return entries.join(own, "path", "left").select(*entries.columns, fault.alias("fault"))


def for_split(entries: DataFrame, split: str) -> DataFrame:
    return entries.filter(F.col("split") == split)


def by_id(entries: DataFrame, entry_id: str) -> DataFrame:
    return entries.filter(F.col("entry_id") == entry_id)


def invalid_entries(entries: DataFrame) -> DataFrame:
    """One row a broken rule of an entry: `entry_id`, `rule`."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("entry_id").rlike("^[a-z0-9][a-z0-9_-]*$"), F.lit(False)), "entry_id"),
        F.when(~F.coalesce(F.col("byte_size") > 0, F.lit(False)), "byte_size"),
        F.when(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "content_hash"),
        F.when((F.col("split") == HELD_OUT) != F.col("frozen_at").isNotNull(), "frozen_at"),
        F.when(blank("issuer"), "issuer"),
        F.when(blank("path"), "path"),
    ))
    return entries.select("entry_id", F.explode(rules).alias("rule"))


def broken_corpus_rules(entries: DataFrame) -> DataFrame:
    """What is wrong with the entries together: `rule`, `what`. Ids are unique, an issuer is in one split, and a superseded entry exists."""
    twice = entries.groupBy("entry_id").count().filter("count > 1").select(F.lit("repeated_id").alias("rule"), F.col("entry_id").alias("what"))
    split = entries.groupBy("issuer").agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("issuer_in_several_splits").alias("rule"), F.col("issuer").alias("what"))
    lost = entries.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("what")).join(entries.select(F.col("entry_id").alias("what")), "what", "left_anti").select(F.lit("supersedes_nothing").alias("rule"), "what")
    return twice.unionByName(split).unionByName(lost)


def unrecorded_fields(entries: DataFrame, fields: list[str]) -> DataFrame:
    """`entry_id`, `unrecorded`: the fields that are null, blank or said to be unknown, in order."""
    open_ = lambda c: F.coalesce(F.lower(F.btrim(F.col(c).cast("string"))), F.lit("")).isin("", "unknown")
    return entries.select("entry_id", F.array_compact(F.array(*(F.when(open_(c), F.lit(c)) for c in fields))).alias("unrecorded"))
