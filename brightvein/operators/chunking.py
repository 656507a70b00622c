"""Chunks of documents: sections under headings, parent windows, and children that fit a budget.

Blocks are rows of `doc_id`, `ordinal`, `element_id`, `text`, `page_number` and
`region_id` (set where a block belongs to a table). Levels come from expressions;
what depends on the blocks before, headings above and the filling of windows, is
one walk through each document. A document's blocks meet in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..seams import TokenCounter, estimated_tokens

CHUNK = "ordinal: int, role: string, parent: int, evidence_type: string, heading_path: array<string>, text: string, element_ids: array<string>, page_numbers: array<int>, token_count: int, char_count: int, notes: array<string>"
#: Notes of a chunk.
SPLIT, JOINED = "split_oversize", "joined_fragments"
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z(₹$])")


@dataclass(frozen=True)
class Budget:
    """Most tokens of a child and of a parent, and the least a child at a window's end should have."""

    child: int = 384
    least: int = 48
    parent: int = 1536
    heading_chars: int = 120


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where sentences begin and end; white space between them belongs to none."""
    gaps = [m.span() for m in _SENTENCE_GAP.finditer(text)]
    return list(zip([0, *(e for _, e in gaps)], [*(s for s, _ in gaps), len(text)]))


def filled(spans: list[tuple[int, int]], fits: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Spans in a row joined as long as their stretch of the text fits; one that doesn't fit alone stays alone."""
    begin = end = None
    for s, e in spans:
        if begin is not None and fits(begin, e):
            end = e
            continue
        if begin is not None:
            yield begin, end
        begin, end = s, e
    if begin is not None:
        yield begin, end


def split_oversize(text: str, most: int, count: TokenCounter = estimated_tokens) -> list[str]:
    """Slices of a text of at most `most` tokens: whole sentences, else whole words, else characters.

    What lies between slices is white space. A text that has no word comes back whole.
    """
    fits = lambda s, e: count(text[s:e]) <= most
    cuts: list[tuple[int, int]] = list(filled(sentence_spans(text), fits))
    for finer in (lambda s, e: [(s + m.start(), s + m.end()) for m in re.finditer(r"\S+", text[s:e])], lambda s, e: [(i, i + 1) for i in range(s, e)]):
        cuts = [x for s, e in cuts for x in ([(s, e)] if fits(s, e) else filled(finer(s, e), fits))]
    return [text[s:e] for s, e in cuts] or [text]


@dataclass
class _Child:
    texts: list[str]
    blocks: list
    notes: set

    def text(self) -> str:
        return "\n".join(self.texts)


def _children(window: list, budget: Budget, count: TokenCounter) -> list[_Child]:
    """The blocks of a window as children: filled greedily, oversize blocks by themselves in slices, a short tail absorbed."""
    out: list[_Child] = []
    used = 0
    for b in window:
        n = b.tokens
        if n > budget.child:
            parts = split_oversize(b.text, budget.child, count)
            out += [_Child([p], [b], {SPLIT} if p != b.text else set()) for p in parts]
            used = budget.child + 1  # nothing joins a slice
        elif out and used and used + n <= budget.child:
            out[-1].texts.append(b.text)
            out[-1].blocks.append(b)
            out[-1].notes.add(JOINED)
            used += n
        else:
            out.append(_Child([b.text], [b], set()))
            used = n
    if len(out) > 1 and count(out[-1].text()) < budget.least and SPLIT not in out[-1].notes | out[-2].notes:
        both = _Child([*out[-2].texts, *out[-1].texts], [*out[-2].blocks, *out[-1].blocks], out[-2].notes | out[-1].notes | {JOINED})
        if count(both.text()) <= budget.child:
            out[-2:] = [both]
    return out


def levelled(blocks: DataFrame, budget: Budget = Budget()) -> DataFrame:  # noqa: B008
    """Retrievable blocks as `doc_id`, `ordinal`, `element_id`, `text`, `page_number`, `derived` (of a table), `level` and `title` (of headings)."""
    own = blocks.filter(X.is_retrievable(F.col("text"))).withColumn("derived", F.col("region_id").isNotNull())
    own = own.withColumn("level", F.when(~F.col("derived"), X.heading_level(F.col("text"), budget.heading_chars)))
    title = F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("text", r"\s+", " ")))
    return own.select("doc_id", "ordinal", F.col("element_id").cast("string").alias("element_id"), "text", F.col("page_number").cast("int").alias("page_number"), "derived", "level", title.alias("title"))


@dataclass(slots=True)
class _Block:
    element_id: str
    text: str
    page: int | None
    derived: bool
    level: int | None
    title: str | None
    tokens: int


def _runs(blocks: list[_Block]) -> Iterator[tuple[list[str], list[_Block]]]:
    """Runs of one kind under one heading, with the titles above them; three neighbours of one level or more are a list, not headings."""
    at = 0
    while at < len(blocks):
        to = at
        while to < len(blocks) and blocks[to].level == blocks[at].level:
            to += 1
        if to - at >= 3:
            for b in blocks[at:to]:
                b.level = None
        at = to
    stack: list[tuple[int, str]] = []
    run: list[_Block] = []
    for b in blocks:
        if run and (b.level is not None or b.derived != run[-1].derived):
            yield [t for _, t in stack], run
            run = []
        if b.level is not None:
            stack = [*(x for x in stack if x[0] < b.level), (b.level, b.title)]
        run.append(b)
    if run:
        yield [t for _, t in stack], run


def _chunks(blocks: list[_Block], budget: Budget, count: TokenCounter) -> list[tuple]:
    """The chunks of a document's blocks in order, as tuples of `CHUNK`."""
    rows: list[tuple] = []

    def add(role, parent, path, text, members, notes):
        ids = list(dict.fromkeys(m.element_id for m in members))
        pages = sorted({m.page for m in members if m.page is not None})
        rows.append((len(rows), role, parent, "table_derived" if members[0].derived else "narrative", path, text, ids, pages, count(text), len(text), sorted(notes)))

    for path, run in _runs(blocks):
        at = 0
        while at < len(run):
            to, used = at, 0
            while to < len(run) and (to == at or used + run[to].tokens <= budget.parent):
                used += run[to].tokens
                to += 1
            window, at = run[at:to], to
            children = _children(window, budget, count)
            whole = "\n".join(b.text for b in window)
            if len(children) == 1 and children[0].text() == whole:
                add("child", None, path, whole, window, children[0].notes)
                continue
            first = len(rows)
            add("parent", None, path, whole, window, ())
            for c in children:
                add("child", first, path, c.text(), c.blocks, c.notes)
    return rows


def chunked(blocks: DataFrame, budget: Budget = Budget(), count: TokenCounter = estimated_tokens) -> DataFrame:  # noqa: B008
    """`doc_id` and `chunks`: what `chunk` gives, as an array of each document that has any.

    A task walks through its blocks in order of document and ordinal and holds
    one document at a time.
    """
    schema = T.StructType([blocks.schema["doc_id"], *T._parse_datatype_string(f"chunks array<struct<{CHUNK}>>").fields])
    names = [c.split(":")[0] for c in CHUNK.split(", ")]

    def work(batches):
        import pyarrow as pa

        text, number, many = pa.string(), pa.int32(), pa.list_(pa.string())
        types = (number, text, number, text, many, text, many, pa.list_(number), number, number, many)
        made: list[tuple] = []
        chars, held, current = 0, [], None
        kind = None

        def flushed():
            rows = [r for _, rs in made for r in rs]
            edges = [0]
            for _, rs in made:
                edges.append(edges[-1] + len(rs))
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], kind), pa.ListArray.from_arrays(pa.array(edges, number), flat)], names=["doc_id", "chunks"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, element, t, *rest in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7))):
                if held and doc != current:
                    made.append((current, _chunks(held, budget, count)))
                    held = []
                    if len(made) >= 2_000 or chars >= 4_000_000:
                        yield flushed()
                        made, chars = [], 0
                current = doc
                held.append(_Block(element, t, *rest, count(t)))
                chars += len(t)
        if held:
            made.append((current, _chunks(held, budget, count)))
        if made:
            yield flushed()

    own = levelled(blocks, budget).repartition("doc_id").sortWithinPartitions("doc_id", "ordinal", "element_id")
    return own.mapInArrow(work, schema)


def chunk(blocks: DataFrame, budget: Budget = Budget(), count: TokenCounter = estimated_tokens) -> DataFrame:  # noqa: B008
    """Chunks of every document, parents before their children, numbered by `ordinal`; a window of one child is that child alone.

    Defined results: blank blocks and contents lines are left out; null texts
    too; an empty table gives none; blocks of equal ordinal come in order of
    their element id.
    """
    return chunked(blocks, budget, count).select("doc_id", F.inline("chunks"))


def placement(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """`doc_id`, `blocks`, `misplaced`, `uncontained`: of each document with retrievable blocks how many there are, and how many faults `misplaced` and `uncontained` tell of its chunks.

    `documents` is what `chunked` gives: its texts are held against each other
    where they lie, and only the ids of elements are shuffled.
    """
    child = F.filter("chunks", lambda c: c["role"] == "child")
    ids = lambda cut: F.flatten(F.transform(F.filter(child, lambda c: F.array_contains(c["notes"], SPLIT) == cut), lambda c: c["element_ids"]))
    lost = lambda c: c["parent"].isNotNull() & ~F.coalesce((F.get("chunks", c["parent"])["role"] == "parent") & F.contains(F.get("chunks", c["parent"])["text"], c["text"]), F.lit(False))
    told = documents.select("doc_id", F.array_sort(ids(False)).alias("whole"), ids(True).alias("cut"), F.size(F.filter("chunks", lost)).alias("uncontained"))
    want = blocks.filter(X.is_retrievable(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.collect_set(F.col("element_id").cast("string")).alias("ids"))
    none = F.array().cast("array<string>")
    both = want.join(told, "doc_id", "left").withColumns({"whole": F.coalesce("whole", none), "cut": F.coalesce("cut", none)})
    missing = F.size(F.array_except(F.array_except("ids", "whole"), F.col("cut")))
    # in several places, and not as slices alone
    twice = F.filter("whole", lambda x, i: (i > 0) & (x == F.get("whole", i - 1)))
    repeated = F.size(F.array_intersect(F.array_union(twice, F.array_intersect("whole", "cut")), F.col("ids")))
    return both.select("doc_id", "blocks", (missing + repeated).cast("long").alias("misplaced"), F.coalesce("uncontained", F.lit(0)).cast("long").alias("uncontained"))


def misplaced(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrievable blocks that no child holds, or that several do without being split: `doc_id`, `element_id`, `places`."""
    want = blocks.filter(X.is_retrievable(F.col("text"))).select("doc_id", F.col("element_id").cast("string").alias("element_id")).distinct()
    held = chunks.filter("role = 'child'").select("doc_id", F.explode("element_ids").alias("element_id"), F.array_contains("notes", SPLIT).alias("split"))
    places = held.groupBy("doc_id", "element_id").agg(F.count("*").alias("places"), F.bool_and("split").alias("split"))
    both = want.join(places, ["doc_id", "element_id"], "left").withColumn("places", F.coalesce("places", F.lit(0)))
    return both.filter("places = 0 OR (places > 1 AND NOT split)").select("doc_id", "element_id", "places")


def uncontained(chunks: DataFrame) -> DataFrame:
    """Children whose text their parent's does not hold: should be none."""
    parents = chunks.filter("role = 'parent'").select("doc_id", F.col("ordinal").alias("parent"), F.col("text").alias("parent_text"))
    return chunks.filter("parent IS NOT NULL").join(parents, ["doc_id", "parent"], "left").filter("parent_text IS NULL OR NOT contains(parent_text, text)").select("doc_id", "ordinal")


def out_of_order(blocks: DataFrame) -> DataFrame:
    """Blocks whose ordinal does not come after the one before on their way down the pages: should be none."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "ordinal")
    return blocks.withColumn("__before", F.lag("ordinal").over(w)).filter(F.col("ordinal") <= F.col("__before")).select("doc_id", "ordinal")


def enriched(chunks: DataFrame) -> DataFrame:
    """`chunks` with `enriched`: labelled lines of what is known, a blank line, the text; with nothing known the text alone.

    Read from `issuer_name`, `document_type`, `fiscal_period`,
    `reporting_basis`, `currency`, `heading_path` and `page_numbers`.
    """
    said = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(F.trim(value), F.lit("")))
    readable = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    first, last = F.array_min("page_numbers"), F.array_max("page_numbers")
    pages = F.when(first == last, F.concat(F.lit("Page: "), first.cast("string"))).otherwise(F.concat(F.lit("Pages: "), first.cast("string"), F.lit("-"), last.cast("string")))
    lines = F.concat_ws("\n", said("Issuer", F.col("issuer_name")), said("Document", readable("document_type")), said("Period", F.col("fiscal_period")), said("Basis", readable("reporting_basis")), said("Currency", F.col("currency")), said("Section", F.array_join("heading_path", " > ")), pages)
    body = F.coalesce("text", F.lit(""))
    return chunks.withColumn("enriched", F.when(lines == "", body).otherwise(F.concat(lines, F.lit("\n\n"), body)))


def filter_payload(chunks: DataFrame) -> DataFrame:
    """The fields hard filters read, per chunk: the section is the first title above it, the fiscal year that of the period's end; null is unknown."""
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    return chunks.select(
        "chunk_id", "generation_id", *(known(c).alias(c) for c in ("issuer_name", "document_type", "fiscal_period", "reporting_basis", "currency")),
        "evidence_type", F.year("period_end").alias("fiscal_year"), known(F.get("heading_path", F.lit(0))).alias("section"), "page_numbers",
    )
