r"""Chat formatting by columnar byte assembly.

A turn is written as `### role: text </turn>` and a line feed. Inside roles and
texts the characters \ # < (and, in roles, :) get a backslash before them, so
neither `###` nor `</turn>` can appear in a formatted text but as a mark, and
reading is the exact reverse.

Turns are range-partitioned by conversation and turn, so a conversation with
very many turns is dealt out over several tasks; each task assembles runs of
turns of one conversation, at most `PART_BYTES` or one turn, as a part. For a
batch, segment lengths, cumulative offsets and scatter indices come from numpy,
and headers, escaped contents and ends are copied into one preallocated buffer,
which Arrow then holds as the text column.

Defined results: null texts and roles are empty; turns without a number come
first; turns of the same number are ordered by role and text; repeated rows are
repeated turns; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shingles import trimmed

HEAD, MIDDLE, END = b"### ", b": ", b" </turn>\n"
PART_BYTES = 2 << 20
TRAINED = "assistant"
_ESCAPE = 92
_IN_TEXT = np.isin(np.arange(256), [ord("\\"), ord("#"), ord("<")])
_IN_ROLE = _IN_TEXT | (np.arange(256) == ord(":"))


def _column(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = a.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(buffer: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, special: np.ndarray | None) -> None:
    """Copy segment i of `data` to `at[i]` in `buffer`, an escape before each special byte."""
    n = np.diff(offsets)
    marks = special[data] if special is not None else np.zeros(len(data), bool)
    before = np.cumsum(marks) - marks
    first = before[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(n), np.int64)
    to = np.repeat(at - offsets[:-1], n) + np.arange(len(data)) + before - np.repeat(first, n) + marks
    buffer[to] = data
    buffer[to[marks] - 1] = _ESCAPE


def _escaped_lengths(data: np.ndarray, offsets: np.ndarray, special: np.ndarray) -> np.ndarray:
    extra = np.concatenate([[0], np.cumsum(special[data])])
    return np.diff(offsets) + extra[offsets[1:]] - extra[offsets[:-1]]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, their edges, and where each escaped text starts and ends in it."""
    r, ro = _column(role)
    t, to = _column(text)
    n = len(ro) - 1
    rl, tl = _escaped_lengths(r, ro, _IN_ROLE), _escaped_lengths(t, to, _IN_TEXT)
    edge = np.concatenate([[0], np.cumsum(len(HEAD) + rl + len(MIDDLE) + tl + len(END))])
    buffer = np.empty(edge[-1], np.uint8)
    start = edge[:-1] + len(HEAD) + rl + len(MIDDLE)
    for mark, at in ((HEAD, edge[:-1]), (MIDDLE, start - len(MIDDLE)), (END, start + tl)):
        buffer[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(buffer, edge[:-1] + len(HEAD), r, ro, _IN_ROLE)
    _scatter(buffer, start, t, to, _IN_TEXT)
    assert n == len(start)
    return buffer, edge, start, start + tl


def _steps(batch: pa.RecordBatch):
    """The batch in slices of about PART_BYTES of text, unless one turn alone is longer: what is assembled at once."""
    sizes = np.cumsum([x or 0 for x in pc.binary_length(batch.column(3)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = TRAINED) -> DataFrame:
    """Formatted conversations in parts: `conv_id`, `part`, `turns`, `text`, `loss`.

    Parts of a conversation follow each other in order of `part`; most have
    one. `loss` lists the code-point spans of the trained role's (escaped)
    texts in the part's text.
    """
    own = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))))
    own = own.repartitionByRange("conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches):
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId() << 32, 0
        for whole in trimmed(batches):
            for b in _steps(whole):
                buffer, edge, start, end = assemble(b.column(2), b.column(3))
                if len(buffer) >= 1 << 31:
                    raise ValueError("a turn of 2 GB or more does not fit a text column")
                null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                conv = b.column(0).fill_null(0).to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1]) | (edge[1:-1] // PART_BYTES != edge[:-2] // PART_BYTES)]))
                to = np.append(cut[1:], len(conv))
                points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80, dtype=np.int32)])
                trains = np.array([x == trained for x in b.column(2).to_pylist()])
                picked = np.flatnonzero(trains)
                which = np.searchsorted(cut, picked, "right") - 1
                base = points[edge[cut]][which]
                spans = pa.StructArray.from_arrays([pa.array((points[start[picked]] - base).astype(np.int64)), pa.array((points[end[picked]] - base).astype(np.int64))], names=["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(picked, np.append(cut, len(conv))).astype(np.int32)), spans)
                text = pa.Array.from_buffers(pa.string(), len(cut), [None, pa.py_buffer(np.append(edge[cut], edge[-1]).astype(np.int32)), pa.py_buffer(buffer)])
                yield pa.RecordBatch.from_arrays([pa.array(conv[cut], mask=null[cut]), pa.array(task + part + np.arange(len(cut))), pa.array(to - cut), text, lists], schema=_PARTS)
                part += len(cut)

    return own.mapInArrow(work, "conv_id long, part long, turns long, text string, loss array<struct<start:long,end:long>>")


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text; anything else in it is an error."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def chat_digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from its parts: turns and their digest, the text under the loss mask and its digest, and the length.

    A digest runs over a conversation from its first turn to its last, so its
    parts meet in one task; they stream through it, one part in memory at a time.
    """
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def work(batches):
        now, state = None, None
        fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        done = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], schema=pa.schema(fields))
        for b in trimmed(batches):
            rows = []
            for conv, text, loss in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(done(state))
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([done(state)])

    return ordered.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the query adds, to show that marks inside texts survive.
PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(PROBE).alias("text"))
    return chat_digests(format_chat(turns.unionByName(probe)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '[\\#<:]', '', 'g')) + 2 * (length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g')))
    + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
