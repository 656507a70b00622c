"""Scans of documents into pages, blocks and tables, by an injected detector; and the elements made of what it finds.

No PDF library comes with the engine. A detector is a callable from a file's
bytes to dicts; scanning runs it on every file in parallel, and a file it can't
read becomes a failure row instead of ending the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..seams import Detector

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCKS = "path string, page_number int, kind string, text string, box " + BOX + ", rotation int, width double, height double, failure_reason string"
CELLS = f"path string, table_id string, page_number int, r int, c int, text string, bbox {BOX}, reported_row_span int, reported_column_span int, reported_is_header boolean, failure_reason string"


def _scan(files: DataFrame, detector: Detector, schema: str) -> DataFrame:
    names = [c.split()[0] for c in files.sparkSession.createDataFrame([], schema).columns]

    def work(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [{**dict.fromkeys(names), **r, "path": path} for r in detector(bytes(content))]
                except Exception as error:  # whatever the file makes of the detector is the file's failure
                    rows.append({**dict.fromkeys(names), "path": path, "failure_reason": type(error).__name__})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(work, schema)


def scan_blocks(spark: SparkSession, path: str, detector: Detector) -> DataFrame:
    """Blocks of every file under `path` with `displayed`, their box as the page is turned, and `ordinal` down each page, blocks and tables alike."""
    found = _scan(spark.read.format("binaryFile").load(path), detector, BLOCKS)
    shown = F.when(F.col("box").isNotNull(), L.displayed(F.col("box"), F.coalesce("rotation", F.lit(0)), F.coalesce("width", F.lit(0.0)), F.coalesce("height", F.lit(0.0))))
    from ..operators.spatial import reading_order

    return reading_order(found.withColumn("displayed", shown), ["path", "page_number"], [F.col("displayed.y0"), F.col("displayed.x0"), "kind", "text"])


def scan_tables(spark: SparkSession, path: str, detector: Detector) -> DataFrame:
    """Cells of every table a detector finds; places of the grid that it leaves out are absent, with a null box, not empty."""
    found = _scan(spark.read.format("binaryFile").load(path), detector, CELLS)
    size = found.filter("failure_reason IS NULL").groupBy("path", "table_id", "page_number").agg(F.max("r").alias("rows"), F.max("c").alias("columns"))
    grid = size.select("path", "table_id", "page_number", F.explode(F.sequence(F.lit(0), "rows")).alias("r"), "columns").select("path", "table_id", "page_number", "r", F.explode(F.sequence(F.lit(0), "columns")).alias("c"))
    return grid.join(found.filter("failure_reason IS NULL"), ["path", "table_id", "page_number", "r", "c"], "left").unionByName(found.filter("failure_reason IS NOT NULL"))


def run_elements(elements: DataFrame, run_id: str) -> DataFrame:
    """A run's elements, roots first, then by parent and ordinal."""
    return elements.filter(F.col("run_id") == run_id).orderBy(F.col("parent_id").isNotNull(), "parent_id", "ordinal")


#: The exact keys of a location, by element type.
LOCATION = {
    "page": ("page_number", "width", "height", "rotation"),
    "block": ("bbox",),
    "footnote": ("bbox",),
    "table": ("bbox",),
    "cell": ("bbox", "row_index", "column_index", "row_span", "column_span"),
}
LOCATION_TYPE = f"struct<page_number:int,width:double,height:double,rotation:int,bbox:{BOX},row_index:int,column_index:int,row_span:int,column_span:int>"


def decode_location(raw: Column, kind: Column) -> Column:
    """A location from its JSON, null if its keys are not just its type's, or a page is turned by no quarter."""
    keys = F.array_sort(F.map_keys(F.from_json(raw, "map<string,string>")))
    fits = F.lit(False)
    for name, wanted in LOCATION.items():
        fits = fits | ((kind == name) & (keys == F.array(*map(F.lit, sorted(wanted)))))
    out = F.from_json(raw, LOCATION_TYPE)
    turned = out["rotation"].isNull() | out["rotation"].isin(0, 90, 180, 270)
    return F.when(F.coalesce(fits & turned, F.lit(False)), out)


def encode_location(location: Column) -> Column:
    """The JSON of a location: its fields that are set."""
    return F.to_json(location, {"ignoreNullFields": "true"})


def cell_elements(derived: DataFrame) -> DataFrame:
    """Elements of derived table cells: `locator`, `text`, `location` and what the table's structure says of them."""
    box = F.col("bbox") if "bbox" in derived.columns else F.lit(None).cast(BOX)
    location = F.struct(box.alias("bbox"), F.col("r").alias("row_index"), F.col("c").alias("column_index"), F.coalesce("row_span", F.lit(1)).alias("row_span"), F.coalesce("column_span", F.lit(1)).alias("column_span"))
    return derived.filter("text IS NOT NULL").select("table_id", F.lit("cell").alias("element_type"), L.cell_locator(F.col("page_number"), F.col("table_number"), F.col("r"), F.col("c")).alias("locator"), "text", location.alias("location"), *(c for c in ("header_path", "row_label_path", "is_header", "is_total", "units") if c in derived.columns))
