"""From raw documents to packed training sequences, stage by stage.

1. quality: documents that the rules reject go.
2. near_duplicates: of each component of the n-gram Jaccard join one document stays.
3. secrets: the spans found are replaced by their kind in the text.
4. mixing: documents are taken as often as the mix to source weights says.
5. packing: what is left is packed into sequences; one row a piece.

All stages but the last return the columns of `documents`. SQL can't express
the stages from the third on, so there is no ORACLE_SQL; tests/llm holds each
stage's rows against plain Python. An empty table gives an empty result, and
extra columns, whatever they are called, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightvein.llm import mixing, ngram_join, packing, quality, secrets
from brightvein.llm._shared import discard, fresh_name, materialise

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject: null, empty and short texts, repetitive ones, and documents of condemned hosts (a null source is one). Repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each component, null ids last. Texts without a word stay; rows that share id and text are one."""
    return ngram_join.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts; no row goes. Null texts stay null. `n_chars`, where the table has it, follows the redacted text."""
    spans = fresh_name("spans", docs.columns)
    clean = secrets.find_secrets(docs, out=spans, redact="[{}]").drop(spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out rows as the mix says. Texts without a word have size 0 and go; null sources are one source, null ids stay null."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece; repeated rows are packed one by one, null and empty texts are the end id alone, null ids stay null."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
