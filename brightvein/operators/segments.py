"""Postings made where chunks lie: a task walks through its chunks and gives, for a stretch of them at a time, one row a term in order of term.

Nothing is shuffled. A file of such rows is a series of sorted runs, so that a
reader's statistics of row groups and pages tell it which hold a term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occurrences of a stretch, about.
STRETCH = 1_500_000
#: Bytes of a row group.
GROUP = 8 << 20
#: Terms, at most, that are told to a scan one by one; beyond, it gets a list, of which Spark tells Parquet the ends alone.
ONE_BY_ONE = 256


def stretches(batches, width: int, groups: Callable | None = None) -> Iterator[tuple]:
    """Columns before the last, and of the last (lists of terms, null for an empty place) the lists' owners, places and terms: of `STRETCH` occurrences or so at a time.

    With `groups`, which numbers the rows of a table, neighbours of one number
    come together.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def made(held):
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column(width).combine_chunks() if t.num_rows else pa.array([], t.schema.field(width).type)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return [t.column(i).combine_chunks() for i in range(width)], owner, at, lists.flatten()

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b.column(width).flatten())
        if n >= STRETCH:
            whole = pa.Table.from_batches(held)
            cut = whole.num_rows
            if groups:
                number = groups(whole)
                cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield made(whole.slice(0, cut).to_batches())
            held = whole.slice(cut).to_batches()
            n = sum(len(x.column(width).flatten()) for x in held)
    if held:
        yield made(held)


def sorted_terms(terms) -> tuple:
    """Distinct terms in byte order, and each occurrence's number among them (-1 for a null)."""
    import numpy as np
    import pyarrow.compute as pc

    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = -1
    return coded.dictionary.take(order), rank[pc.fill_null(coded.indices, len(order)).to_numpy(zero_copy_only=False)]


def heads(*columns) -> object:
    """Where runs of equal rows begin in columns that are sorted."""
    import numpy as np

    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([np.diff(c) != 0 for c in columns], axis=0)]))


def placed(keys: list[str]) -> Callable:
    """The function that makes of (keys, terms) rows of `term` and `entries`: keys and `at`, the term's places, in the order of the chunks."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for columns, owner, at, terms in stretches(batches, len(keys)):
            names, rank = sorted_terms(terms)
            order = np.argsort(rank, kind="stable")  # chunks and places stay in order
            order = order[np.searchsorted(rank[order], 0) :]
            if not len(order):
                continue
            rank, owner = rank[order], owner[order]
            first = heads(rank, owner)
            own = pa.array(owner[first])
            edge = lambda x, n: pa.array(np.append(x, n).astype(np.int32))
            places = pa.ListArray.from_arrays(edge(first, len(order)), pa.array(at[order].astype(np.int32)))
            entries = pa.StructArray.from_arrays([*(c.take(own) for c in columns), places], names=[*keys, "at"])
            begin = heads(rank[first])
            rows = pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(edge(begin, len(first)), entries)], names=["term", "entries"])
            for i in range(0, rows.num_rows, 10_000):
                yield rows.slice(i, 10_000)

    return work


def written(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)


def holds(terms: list[str]) -> Column:
    """The filter of a scan for terms."""
    if not 0 < len(terms) <= ONE_BY_ONE:
        return F.col("term").isin(terms)
    return reduce(lambda a, b: a | b, (F.col("term") == t for t in terms))
