"""HTML pages as blocks and as grids of declared spans, by a Python data source over stored pages or by an operator over any column.

Blocks are headings, paragraphs, list items and table cells in the order they
are written. A cell takes the first free place of its row; spans that reach down
from rows above keep their places. What a span covers is absent; a declared cell
without text is there and empty, which is another thing.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What is left out, what begins a block, and the widest span that is taken.
HIDDEN = ("script", "style", "template", "noscript")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PARTS = ("p", "li", "blockquote", "pre", "dt", "dd", "figcaption", "caption", "footer", "address")
SPAN = 1000
#: An ampersand that begins no character reference ended by a semicolon.
_OPEN = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")

BLOCK = "ordinal int, kind string, level int, text string, grid int, r int, c int, row_span int, column_span int, is_header boolean"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]


class _Page(HTMLParser):
    """Collects a page's blocks; unclosed elements end where the next of their kind begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.kind, self.level, self.parts, self.hidden = None, None, [], 0
        self.tables: list[dict] = []
        self.grids = 0

    def _end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not (self.tables and self.tables[-1]["cell"] is not None):
            self.blocks.append((self.kind or "text", self.level, text, None, None, None, None, None, None))
            self.parts = []
        elif not self.tables or self.tables[-1]["cell"] is None:
            self.parts = []

    def _close_cell(self) -> None:
        table = self.tables[-1]
        if table["cell"] is not None:
            row, span, header = table["cell"]
            text = " ".join("".join(self.parts).split())
            row.append((text, *span, header))
            table["cell"], self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "table":
            if self.tables:
                self._close_cell()
            else:
                self._end()
            self.tables.append({"rows": [], "cell": None, "sections": []})
        elif self.tables and tag in ("tr", "thead", "tbody", "tfoot"):
            self._close_cell()
            table = self.tables[-1]
            if tag == "tr":
                table["rows"].append([])
            elif table["rows"]:
                table["sections"].append(len(table["rows"]))
        elif self.tables and tag in ("td", "th"):
            self._close_cell()
            table = self.tables[-1]
            if not table["rows"]:
                table["rows"].append([])
            given = dict(attrs)
            number = lambda name, least: min(max(int(given[name]), least), SPAN) if (given.get(name) or "").strip().isdecimal() else 1
            table["cell"] = (table["rows"][-1], (number("rowspan", 0), number("colspan", 1)), tag == "th")
            self.parts = []
        elif tag == "br":
            self.parts.append(" ")
        elif tag in HEADINGS or tag in PARTS or tag in ("div", "article", "section", "ul", "ol", "nav", "body", "tr"):
            if self.tables and self.tables[-1]["cell"] is not None:
                self.parts.append(" ")
                return
            self._end()
            self.kind = "heading" if tag in HEADINGS else "item" if tag in ("li", "dt", "dd") else "paragraph" if tag in PARTS else None
            self.level = int(tag[1]) if tag in HEADINGS else None

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "table" and self.tables:
            self._close_cell()
            table = self.tables.pop()
            for r, c, text, down, across, header in placed(table["rows"], table["sections"]):
                self.blocks.append(("cell", None, text, self.grids, r, c, down, across, header))
            self.grids += 1
            self.parts = []
        elif self.tables and tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag in HEADINGS or tag in PARTS or tag in ("div", "article", "section", "ul", "ol", "nav", "body", "title"):
            if self.tables and self.tables[-1]["cell"] is not None:
                self.parts.append(" ")
                return
            if tag == "title":
                self.kind, self.level = "title", None
            self._end()
            self.kind = self.level = None

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)

    def done(self) -> list[tuple]:
        while self.tables:
            self.handle_endtag("table")
        self._end()
        return [(i, *b) for i, b in enumerate(self.blocks)]


def placed(rows: list[list[tuple]], sections: list[int] = ()) -> list[tuple]:
    """(row, column, text, rows, columns, is header) of declared cells: an occupancy sweep, row by row.

    A cell of no rows reaches to the end of its section; spans end with the
    section; a place that two spans claim is the earlier one's.
    """
    ends = sorted({*sections, len(rows)})
    out, taken = [], {}  # column -> the first row below in which it is free again
    for r, row in enumerate(rows):
        end = next(e for e in ends if e > r)
        c = 0
        for text, down, across, header in row:
            while taken.get(c, 0) > r:
                c += 1
            down = end - r if down == 0 else min(down, end - r)
            width = 1
            while width < across and taken.get(c + width, 0) <= r:
                width += 1
            for x in range(c, c + width):
                taken[x] = r + down
            out.append((r, c, text, down, width, header))
            c += width
    return out


def parsed(html: str | None, closed: bool = False) -> list[tuple]:
    """A page's blocks as rows of `BLOCK`; none for null. With `closed`, character references count only if a semicolon ends them: one that a cut has left open stays as written."""
    page = _Page()
    page.feed(_OPEN.sub("&amp;", html or "") if closed else html or "")
    page.close()
    return page.done()


def html_blocks(pages: DataFrame, key: str, html_col: str = "html", closed: bool = False) -> DataFrame:
    """`key` and the columns of `BLOCK`: one row a block of each page; `closed` as in `parsed`."""
    schema = T.StructType([pages.schema[key], *T._parse_datatype_string(BLOCK).fields])

    def work(batches):
        import pyarrow as pa

        for b in batches:
            for i, html in enumerate(b.column(1).to_pylist()):
                rows = parsed(html, closed)
                if rows:
                    columns = list(zip(*rows))
                    at = pa.array([i] * len(rows))
                    made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), *made], names=[key, *_NAMES])

    return pages.select(key, html_col).mapInArrow(work, schema)


def grids(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Tables as `tables.derive` takes them: `table_id`, `r`, `c`, `text`, `present`, the spans as reported, `declared_header`; places that a span covers, or no cell, are absent.

    `blocks` is what `html_blocks` gives, `by` what tells pages apart.
    """
    cells = blocks.filter("kind = 'cell'").withColumn("table_id", F.concat_ws("/", *by, "grid")).select("table_id", "r", "c", "text", "row_span", "column_span", "is_header")
    shape = cells.groupBy("table_id").agg(F.max(F.col("r") + F.col("row_span")).alias("rows"), F.max(F.col("c") + F.col("column_span")).alias("columns"))
    places = shape.select("table_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), "columns").select("table_id", "r", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))
    both = places.join(cells, ["table_id", "r", "c"], "left")
    there = F.col("row_span").isNotNull()
    return both.select("table_id", "r", "c", F.coalesce("text", F.lit("")).alias("text"), there.alias("present"), "row_span", "column_span", F.coalesce("is_header", F.lit(False)).alias("declared_header"))


def page_grids(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """What `grids` gives for pages told apart by `key`, made where a page is parsed: nothing is shuffled."""
    schema = "table_id string, r int, c int, text string, present boolean, row_span int, column_span int, declared_header boolean"
    types = T._parse_datatype_string(schema)

    def work(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_())
        for b in batches:
            rows: list[tuple] = []
            for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += _places(name, parsed(html))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=types.names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=types.names)

    # as concat_ws does, a null key leaves the grid's number alone
    return pages.select(F.col(key).cast("string"), html_col).mapInArrow(work, types)


def _places(name: str | None, blocks: list[tuple]) -> list[tuple]:
    """The places of all grids of a page, absent ones too."""
    grids: dict[int, list[tuple]] = {}
    for b in blocks:
        if b[1] == "cell":
            grids.setdefault(b[4], []).append(b)
    out = []
    for grid, cells in grids.items():
        table = str(grid) if name is None else f"{name}/{grid}"
        at = {(b[5], b[6]): b for b in cells}
        columns = range(max(b[6] + b[8] for b in cells))
        for r in range(max(b[5] + b[7] for b in cells)):
            for c in columns:
                b = at.get((r, c))
                out.append((table, r, c, "", False, None, None, False) if b is None else (table, r, c, b[3], True, b[7], b[8], b[9]))
    return out


class HtmlPages(DataSource):
    """`spark.read.format("html_pages").load(folder)`: the blocks of the HTML files under a folder that all executors see, one partition a file."""

    @classmethod
    def name(cls) -> str:
        return "html_pages"

    def schema(self) -> str:
        return f"path string, {BLOCK}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("html_pages needs a path")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith((".html", ".htm"))]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with store.open_input_stream(partition.value) as f:
            html = f.read().decode("utf-8", "replace")
        for row in parsed(html):
            yield (partition.value, *row)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HtmlPages)
