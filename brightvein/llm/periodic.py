"""Periodic runs of words: stretches that repeat themselves `LEAST` times or more.

All-lag scan: the array of a text's words, as 64-bit hashes, is compared with
itself shifted by every lag up to n / LEAST, and the true stretches are run-length
encoded. A stretch that lasts LEAST - 1 lags holds so many neighbouring multiples
of its lag, so all lags are first compared at their multiples alone (n / lag
places each, in one pass over all lags); a lag without such neighbours has no run
and is not compared in full. Multiples of a lag inside a run already found are
that same run and are passed over.

A text above `LONG` bytes is dealt out by ranges of lags, each of them a row that
any machine may take; what they find is merged by text. All others are scanned
where they lie, without a shuffle.

Defined results: null and empty texts and texts of fewer than `SHORTEST` words
have no runs; repeated rows get equal runs; an empty table gives an empty result;
extra columns pass through (one called like an output gives way to it). Words of
eight bytes or more are told apart by their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh_name, text_of, words_of
from ._shingles import _SPACES, hashes, steps, trimmed

#: A run has at least so many periods, and so many words.
LEAST, SHORTEST = 4, 6
#: Bytes of a text above which its lags are dealt out.
LONG = 8 << 20
#: Pairs of words compared at once.
PAIRS = 1 << 20
#: A range of lags begins with these as well, so that it knows the runs whose multiples it may pass over.
FIRST_LAGS = 64

_RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each text's first word (one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACES[data]
    cut = np.zeros(len(data) + 1, bool)  # texts lie back to back: a word ends where its text does
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def _candidates(h: np.ndarray, lags: np.ndarray, least: int):
    """(lag, place) of each `least` - 1 neighbouring multiples of a lag at which the shifted array agrees, ascending by lag."""
    n, t = len(h), least - 1
    many = (n - 1) // lags
    total = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(lags):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        lag = np.repeat(lags[a:b], many[a:b])
        at = (np.arange(len(lag)) - np.repeat(total[a:b] - total[a], many[a:b])) * lag
        same = h[at] == h[at + lag]
        if len(same) >= t:
            alike = same[: len(same) - t + 1].copy()
            for j in range(1, t):
                alike &= same[j : len(same) - t + 1 + j]
            alike &= lag[: len(alike)] == lag[t - 1 :]
            hit = np.flatnonzero(alike)
            if len(hit):
                yield lag[hit], at[hit]
        a = b


def runs_of(h: np.ndarray, lo: int = 1, hi: int | None = None, least: int = LEAST, shortest: int = SHORTEST) -> np.ndarray:
    """`start`, `length`, `period` of the runs of an array whose period is in [lo, hi) (and of those below `FIRST_LAGS`), by start, then period.

    Where the same stretch has several periods it is given once, with the least of these.
    """
    n = len(h)
    top = n // least + 1 if hi is None else min(hi, n // least + 1)
    lags = np.concatenate([np.arange(1, min(lo, FIRST_LAGS)), np.arange(lo, max(top, lo))])
    lags = lags[lags < top]
    out: list[np.ndarray] = []
    inner: list[tuple[int, np.ndarray, np.ndarray]] = []  # runs long enough to be runs of a multiple too

    def outside(lag: np.ndarray, at: np.ndarray, q: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Candidates that no run of period q explains; runs of one period overlap by less than it, so the last to begin decides."""
        i = np.searchsorted(start, at, "right") - 1
        return ~((lag % q == 0) & (i >= 0) & (at + (least - 1) * lag < end[np.maximum(i, 0)]))

    for lag, at in _candidates(h, lags, least) if n >= shortest and len(lags) else ():
        for q, start, end in inner:
            keep = outside(lag, at, q, start, end)
            lag, at = lag[keep], at[keep]
        while len(lag):
            q = int(lag[0])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (h[q:] == h[:-q]).view(np.int8), [0]])))
            start, length = edge[::2], edge[1::2] - edge[::2] + q
            full = length >= max(shortest, least * q)
            start, length = start[full], length[full]
            out.append(np.stack([start, length, np.full(len(start), q)], 1))
            rest = np.searchsorted(lag, q, "right")
            lag, at = lag[rest:], at[rest:]
            twice = length >= 2 * least * q
            if twice.any():
                inner.append((q, start[twice], (start + length)[twice]))
                keep = outside(lag, at, *inner[-1])
                lag, at = lag[keep], at[keep]
    found = np.concatenate([np.zeros((0, 3), np.int64), *out])
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.concatenate([[True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)])
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _ranges(texts: DataFrame) -> DataFrame:
    """`t`, `text`, `lo`, `hi`: a text's lags in ranges whose scans cost about the same."""
    powers = F.sequence(F.lit(6), F.greatest(F.lit(6), F.floor(F.log2(F.octet_length("text") / F.lit(2.0 * LEAST))).cast("int")))
    return texts.select("t", "text", F.explode(powers).alias("e")).select("t", "text", F.when(F.col("e") == 6, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.col("e"))).cast("long").alias("lo"), F.pow(F.lit(2.0), F.col("e") + 1).cast("long").alias("hi"))


def _runs_by_text(long: DataFrame) -> DataFrame:
    """`t`, `runs` of each different text, found range by range on whichever machines are free."""

    def work(batches):
        for b in trimmed(batches):
            lows, highs, names = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(0)
            for i in range(b.num_rows):
                for _, data, offsets in steps(b.column(1).slice(i, 1)):
                    start, end, _ = _places(data, offsets)
                    runs = runs_of(hashes(data, start, end - start), lows[i], highs[i])
                    yield pa.RecordBatch.from_arrays([pa.array([names[i].as_py()] * len(runs), pa.string()), *(pa.array(runs[:, c]) for c in range(3))], names=["t", "start", "length", "period"])

    units = _ranges(long.dropDuplicates(["t"])).repartition("t", "lo")
    found = units.mapInArrow(work, "t string, start long, length long, period long").groupBy("t", "start", "length").agg(F.min("period").alias("period"))
    return found.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")).select("t", F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def periodic_runs(docs: DataFrame, text_col: str = "text", out: str = "runs", collapsed: str = "collapsed", long: int = LONG) -> DataFrame:
    """`docs` with `out`, each text's runs by start, then period, and `collapsed`, its words less what runs repeat, joined by one space."""
    if text_col.lower() in (out.lower(), collapsed.lower()):
        raise ValueError("an output is the text column")
    keep = [c for c in docs.columns if c.lower() not in (out.lower(), collapsed.lower())]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    text, t = text_of(F.col(f"`{text_col}`")), fresh_name("t", [*keep, out])
    above = F.octet_length(text) > long
    far = docs.filter(above).withColumn(t, F.sha2(F.encode(text, "UTF-8"), 256))
    found = _runs_by_text(far.select(F.col(t).alias("t"), F.col(f"`{text_col}`").alias("text"))).select(F.col("t").alias(t), F.coalesce("runs", F.array().cast(_RUNS)).alias(out))
    with_runs = far.join(found, t, "left").select(*(F.col(f"`{c}`") for c in keep), F.coalesce(out, F.array().cast(_RUNS)).alias(out))
    whole = docs.filter(~above).withColumn(out, F.lit(None).cast(_RUNS)).unionByName(with_runs)
    at = [c.lower() for c in keep].index(text_col.lower())

    def work(batches):
        for b in trimmed(batches):
            given = b.column(b.num_columns - 1)
            for row, data, offsets in steps(b.column(at)):
                start, end, first = _places(data, offsets)
                h = hashes(data, start, end - start)
                told, texts = [], []
                for d in range(len(offsets) - 1):
                    lo, hi = first[d], first[d + 1]
                    known = given[row + d]
                    runs = np.array([[r["start"], r["length"], r["period"]] for r in known.as_py()], np.int64).reshape(-1, 3) if known.is_valid else runs_of(h[lo:hi])
                    kept = np.flatnonzero(_kept(hi - lo, runs)) + lo if len(runs) else np.arange(lo, hi)
                    told.append(runs)
                    raw = data[offsets[d] : offsets[d + 1]].tobytes()
                    texts.append(b" ".join(raw.split()) if not len(runs) else b" ".join([raw[s:e] for s, e in zip((start[kept] - offsets[d]).tolist(), (end[kept] - offsets[d]).tolist())]))
                flat = np.concatenate(told)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in told])]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"]))
                rows = b.slice(row, len(told))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists.cast(_ARROW), pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, out, collapsed])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, _RUNS), T.StructField(collapsed, T.StringType())])
    return whole.mapInArrow(work, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the first, of these that of the least period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def planted(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text`, with a periodic end in one document in ten: from word a on, its words go round with period p. A null id has no number and plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    cut = docs.filter(hit).select("doc_id", "text", F.floor(h / 10).alias("g"), words_of(text_of("text")).alias("w")).withColumn("n", F.size("w").cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")).otherwise(0).cast("int")).withColumn("p", F.expr("CAST(1 + floor((n - a) / (3 + g % 8)) AS int)"))
    rounds = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS int))), 1, CAST(n - a AS int))")
    turned = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), rounds), " ")).otherwise(F.col("text"))
    return docs.filter(~hit).select("doc_id", "text").unionAll(cut.select("doc_id", turned.alias("text")))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit(None))), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
