"""Repair of conversation structure by the cheapest edits.

A conversation should be an optional system turn and then pairs of a user's and
an assistant's turn, told by the initials of their roles: `(s?(ua)+)?`. Keep
costs 0, Rerole (to user or assistant) 1, Delete 2, Insert of an empty user or
assistant turn 5; a blank or repeated turn must go, and a truncated one that
stays adds 5. Of the cheapest edits those whose letters, in order, are least in
ASCII are made.

Bidirectional tight-arc DAG: nodes are (turns passed, state), arcs are edits.
Least costs from the start and to the end tell for each arc whether a cheapest
path takes it; from the start a set of states follows, at each step, the least
letter of the arcs that do.

A conversation may hold any share of the rows. Its rows are sorted by range, so
they spread over many partitions, and cut into blocks of bounded size. A block
is a 4 x 4 matrix of least costs; one light pass over the matrices of a
conversation gives each block the costs at its ends. Only letters and digests,
which run from a conversation's first turn to its last, pass through one task a
conversation, one batch of blocks in memory at a time.

Defined results: null roles and texts are one space; turns go by number (nulls
first), then role, then text; equal rows stay, the first of them is no
duplicate; a null id is a conversation like any other; a role without a legal
initial is reroled or deleted; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, materialise
from ._shingles import trimmed

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FAR = 1 << 40
#: Rows and characters of a block, unless one row alone is longer.
ROWS, CHARS = 1024, 1 << 16
#: What a user's, an assistant's and a system turn do to the state.
_USER, _ASSISTANT, _SYSTEM = ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), ((USER, ASSISTANT),), ((START, SYSTEM),)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row by code; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

_INSERTS = tuple(("I", q, r, INSERT) for q, r in _USER + _ASSISTANT)


def _arcs(initial: str, fault: int) -> tuple:
    """(letter, from, to, cost) of all edits of one row, by letter."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if fault in (SOUND, TRUNCATED):
        more = CUT if fault == TRUNCATED else 0
        arcs += [("K", q, r, KEEP + more) for q, r in {"u": _USER, "a": _ASSISTANT, "s": _SYSTEM}.get(initial, ())]
        arcs += [("R", q, r, REROLE + more) for q, r in _USER + _ASSISTANT]
    return tuple(arcs)


ARCS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 4 x 4 matrices of costs: sums along a path, the least over paths."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _matrix(arcs) -> np.ndarray:
    m = np.full((4, 4), FAR, np.int64)
    for _, q, r, c in arcs:
        m[q, r] = min(m[q, r], c)
    return m


_NONE = np.where(np.eye(4, dtype=bool), 0, FAR)
_ANY_INSERTS = _times(np.minimum(_matrix(_INSERTS), _NONE), np.minimum(_matrix(_INSERTS), _NONE))
#: Any inserts and then one row, by its code.
_STEPS = {k: _times(_ANY_INSERTS, _matrix(v)) for k, v in ARCS.items()}
#: What the states cost at a conversation's end.
_END = _times(_ANY_INSERTS, np.array([[0], [FAR], [FAR], [0]]).repeat(4, 1))[:, 0]


def block_matrix(codes: list) -> np.ndarray:
    """The least costs from each state before a block's rows to each state after them."""
    m = np.array([_STEPS[c] for c in codes])
    while len(m) > 1:
        half = _times(m[: len(m) // 2 * 2 : 2], m[1::2])
        m = np.concatenate([half, m[-1:]]) if len(m) % 2 else half
    return m[0] if len(m) else _NONE


def _inserted(v: list, back: bool) -> list:
    """The least costs of a layer's states once any inserts are made, from the start on or back from the end."""
    v = list(v)
    for _ in range(2):
        for _, q, r, c in _INSERTS:
            if back:
                v[q] = min(v[q], v[r] + c)
            else:
                v[r] = min(v[r], v[q] + c)
    return v


def edits(codes: list, before: list, after: list, total: int, frontier: set[int]) -> tuple[list, set[int]]:
    """The (letter, state) of each edit of a block and the states it ends in, of which all belong to the least audit so far.

    `before` has the least costs from the start to the states before the block,
    `after` those from the states after it to the end.
    """
    forward, backward = [_inserted(before, False)], [_inserted(after, True)]
    for c in codes:
        v = [FAR] * 4
        for _, q, r, cost in ARCS[c]:
            v[r] = min(v[r], forward[-1][q] + cost)
        forward.append(_inserted(v, False))
    for c in reversed(codes):
        v = [FAR] * 4
        for _, q, r, cost in ARCS[c]:
            v[q] = min(v[q], cost + backward[-1][r])
        backward.append(_inserted(v, True))
    backward.reverse()
    out, i = [], 0
    while i < len(codes):
        tight = [(letter, r, 1) for letter, q, r, c in ARCS[codes[i]] if q in frontier and forward[i][q] + c + backward[i + 1][r] == total]
        tight += [("I", r, 0) for _, q, r, c in _INSERTS if q in frontier and forward[i][q] + c + backward[i][r] == total]
        least = min(t[0] for t in tight)
        frontier = {r for letter, r, _ in tight if letter == least}
        out.append((least, min(frontier)))
        i += least != "I"
    return out, frontier


def closing(frontier: set[int]) -> list:
    """The inserts after the last row."""
    return {START: [], SYSTEM: [("I", USER), ("I", ASSISTANT)], USER: [("I", ASSISTANT)], ASSISTANT: []}[min(frontier)]


def with_faults(turns: DataFrame) -> DataFrame:
    """Different rows with how often each is there (`copies`), its first fault and whether a copy of its role and text came before.

    Counts and first places are aggregated before anything is shuffled; texts
    meet in the join alone, which Spark splits where a key is frequent.
    """
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = said.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn")))
    firsts = said.select("conv_id", "role", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), F.struct(F.col("turn").isNotNull().alias("set"), F.coalesce("turn", F.lit(0)).alias("turn")).alias("place"))
    firsts = firsts.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"))
    a, b = rows.alias("a"), firsts.alias("b")
    on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest"))
    again = F.col("a.place") != F.col("b.first")
    blank = F.length(F.regexp_replace("a.text", SPACE, "")) == 0
    whole = F.col("a.text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(~whole, TRUNCATED).otherwise(SOUND)
    return a.join(b, on).select("a.conv_id", "a.turn", "a.role", "a.text", "a.copies", fault.alias("fault"))


_BLOCK = [("conv_id", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.binary()), ("costs", pa.list_(pa.int64()))]
_BLOCK_SQL = "conv_id long, part long, nth long, turns array<long>, roles array<string>, texts array<string>, faults binary, costs array<long>"


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def _codes(roles: list, faults: bytes) -> list:
    return [(_initial(r), f) for r, f in zip(roles, faults)]


def blocks(turns: DataFrame) -> DataFrame:
    """The rows of `with_faults` in order, in blocks of bounded size: `conv_id`, `part` and `nth` (which give the order), rows, and the block's matrix."""

    def work(batches):
        part, nth, now = TaskContext.get().partitionId(), 0, None
        held, chars = [], 0

        def row():
            turn, role, text, fault = zip(*held)
            codes = bytes(fault)
            return [now[0], part, nth, list(turn), list(role), list(text), codes, block_matrix(_codes(role, codes)).ravel().tolist()]

        table = lambda made: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), _BLOCK)], schema=pa.schema(_BLOCK))
        for b in trimmed(batches):
            made, size = [], 0
            for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in b.columns)):
                for i in range(copies):
                    if held and ((conv,) != now or len(held) >= ROWS or chars + len(text) > CHARS):
                        made.append(row())
                        nth, held, size, chars = nth + 1, [], size + chars, 0
                        if size > 1 << 23:
                            yield table(made)
                            made, size = [], 0
                    now = (conv,)
                    held.append((turn, role, text, DUPLICATE if i and fault != BLANK else fault))
                    chars += len(text)
            if made:
                yield table(made)
        if held:
            yield table([row()])

    rows = with_faults(turns)
    spread = rows.withColumn("head", F.left("text", F.lit(64))).repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text").drop("head")
    return materialise(spread.mapInArrow(work, _BLOCK_SQL), "turn-blocks")


def _ends(found: DataFrame) -> DataFrame:
    """`conv_id`, `part`, `nth`, `before`, `after`, `total`: the least costs at each block's ends and of the whole, from the matrices of its conversation alone."""

    def work(batches):
        now, held = None, []

        def told():
            m = np.array([x[2] for x in held]).reshape(-1, 4, 4)
            before, after = [np.array([0, FAR, FAR, FAR])], [_END]
            for x in m[:-1]:
                before.append(_times(before[-1][None, :], x)[0])
            for x in m[:0:-1]:
                after.append(_times(x, after[-1][:, None])[:, 0])
            total = int(_times(m[0], after[-1][:, None])[START, 0])
            return [(now[0], p, n, b.tolist(), a.tolist(), total) for (p, n, _), b, a in zip(held, before, after[::-1])]

        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "part", "nth", "before", "after", "total"])
        for b in trimmed(batches):
            rows = []
            for conv, part, nth, costs in zip(*(c.to_pylist() for c in b.columns)):
                if held and (conv,) != now:
                    rows += told()
                    held = []
                now = (conv,)
                held.append((part, nth, costs))
            if rows:
                yield table(rows)
        if held:
            yield table(told())

    light = found.select("conv_id", "part", "nth", "costs").repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return light.mapInArrow(work, "conv_id long, part long, nth long, before array<long>, after array<long>, total long")


class _Talk:
    """What is known of a conversation while its blocks go by."""

    def __init__(self, conv):
        self.conv, self.total, self.frontier, self.audit = conv, 0, {START}, bytearray()
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = 0
        self.faults, self.last, self.sha, self.any, self.place = [0, 0, 0, 0], None, hashlib.sha256(), False, 0

    def block(self, turns, roles, faults, before, after, total) -> list:
        """Takes a block; returns its edits."""
        for t in turns:
            if t is not None and (t != self.turn or not self.distinct):
                self.low, self.high, self.distinct = t if self.low is None else self.low, t, self.distinct + 1
                self.turn = t
        initials = [r[:1] for r in roles]
        self.illegal += sum(a + b not in ("su", "ua", "au") for a, b in pairwise(([self.last] if self.last is not None else []) + initials))
        self.last = initials[-1]
        for f in faults:
            self.faults[f] += 1
        self.total = total
        made, self.frontier = edits(_codes(roles, faults), before, after, total, self.frontier)
        return made

    def written(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.any + f"{role}:{text}").encode())
        self.any = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.total, self.audit.decode(), self.sha.hexdigest())


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPAIRED = "conv_id long, place long, turn long, role string, text string, edit string"


def _stream(turns: DataFrame, asked: DataFrame, whole: bool) -> DataFrame:
    """One row a conversation, or with `whole` the repaired turns themselves."""
    found = blocks(turns)
    ends = _ends(found)
    rows, costs = ["turns", "roles", "texts", "faults"], ["before", "after", "total"]
    none = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    zero = F.lit(-1).cast("long")
    ids = asked.select(F.col("conv_id").cast("long")).distinct().select("conv_id", zero.alias("part"), zero.alias("nth"), F.lit(0).alias("sort"), *none(found, rows), *none(ends, costs))
    light = ends.select("conv_id", "part", "nth", F.lit(0).alias("sort"), *none(found, rows), *costs)
    own = found.select("conv_id", "part", "nth", F.lit(1).alias("sort"), *rows, *none(ends, costs))
    ordered = ids.unionByName(light).unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth", "sort")
    types = [pa.int64()] * 3 + [pa.string()] * 3 if whole else [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split()[0] for x in (_REPAIRED if whole else _SUMMARY).split(", ")]

    def work(batches):
        talk, vectors = None, None
        table = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        def emit(out, made, turns, roles, texts):
            i = 0
            for letter, state in made:
                talk.audit += letter.encode()
                i += letter != "I"
                if letter == "D":
                    continue
                role = roles[i - 1] if letter == "K" else _NAMES[state]
                text, turn = ("", None) if letter == "I" else (texts[i - 1], turns[i - 1])
                if whole:
                    out.append((talk.conv, talk.place, turn, role, text, letter))
                    talk.place += 1
                else:
                    talk.written(role, text)

        def close(out):
            emit(out, closing(talk.frontier), [], [], [])
            if not whole:
                out.append(talk.row())

        for b in trimmed(batches):
            out, value = [], lambda c, i: b.column(c)[i].as_py()
            for i, (conv, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                if talk is None or conv != talk.conv:
                    if talk is not None:
                        close(out)
                    talk = _Talk(conv)
                if kind:
                    turns, roles, texts = value(4, i), value(5, i), value(6, i)
                    emit(out, talk.block(turns, roles, value(7, i), *vectors), turns, roles, texts)
                    if whole and len(out) > 4 * ROWS:
                        yield table(out)
                        out = []
                else:
                    vectors = [value(c, i) for c in (8, 9, 10)]
            if out:
                yield table(out)
        if talk is not None:
            out = []
            close(out)
            if out:
                yield table(out)

    return ordered.mapInArrow(work, _REPAIRED if whole else _SUMMARY)


def repair(turns: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """One row for each conversation of `turns` (or of `asked`, for those without a row left): its gaps, faults, illegal neighbours, the least `cost`, the `audit` of edits and the digest of the repaired turns."""
    return _stream(turns, turns if asked is None else asked.select("conv_id").unionByName(turns.select("conv_id")), False)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns that stay or are made, in order: `place` from 0, `turn` (null for an insert), `role`, `text` and the `edit` that led to them."""
    return _stream(turns, turns, True)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of `conversations` with a fault put into one in four, by what their ids and turns hash to; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(said("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind != 0")
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(turns), turns)
