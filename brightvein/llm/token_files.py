"""Token-id files with fixed-width bit packing.

An id takes the fewest bits that hold the vocabulary. Ids are packed in blocks
of `BLOCK`; the block offsets in the file's footer let any range of ids be read
and unpacked by itself. One file, all numbers little-endian:

    "BVBITS01" | packed blocks | doc ids i64[d] | null flags u8[d] |
    first id of each doc u64[d + 1] | block byte offsets u64[b + 1] |
    trailer: u64 ids, u64 docs, u64 blocks, u32 bits, u32 block, u64 footer offset

Documents lie in ascending id order within a file and across files. A task
writes its file under a name of its own and returns a manifest row; the
manifest is a written table, so the files of failed attempts are never listed.

Defined results: null and empty texts hold the end id alone; null document ids
come first; repeated ids stay in order of their text; an empty table gives no
files and an empty result.
"""

from __future__ import annotations

import posixpath
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._encode import encoder
from ._shingles import trimmed
from ._shared import fresh_path, materialise, text_of

MAGIC = b"BVBITS01"
BLOCK = 4096
_TRAILER = struct.Struct("<QQQIIQ")


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive `bits`-wide little-endian fields, padded to a whole byte."""
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]).tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        wide = np.zeros((n, 4), np.uint8)
        wide[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
        return wide.view("<u4").ravel()
    spread = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams ids to one file; holds at most a block of them."""

    def __init__(self, stream, bits: int, block: int = BLOCK):
        self.stream, self.bits, self.block = stream, bits, block
        self.stream.write(MAGIC)
        self.at, self.total = len(MAGIC), 0
        self.rest = np.zeros(0, np.uint32)
        self.offsets, self.ids, self.nulls, self.firsts = [self.at], [], [], [0]

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids += [x or 0 for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.firsts += (self.total + np.cumsum(counts)).tolist()
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        self.stream.write(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.firsts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.stream.write(_TRAILER.pack(self.total, len(self.ids), len(self.offsets) - 1, self.bits, self.block, self.at))
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        self.total, docs, blocks, self.bits, self.block, footer = _TRAILER.unpack(file.read_at(_TRAILER.size, size - _TRAILER.size))
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token-id file")
        raw, at = file.read_at(size - _TRAILER.size - footer, footer), 0
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.firsts = np.frombuffer(raw, "<u8", docs + 1, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 9 * docs + 8 * (docs + 1)).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n, reading only the blocks they lie in."""
        if n <= 0:
            return np.zeros(0, np.uint32)
        b0, b1 = start // self.block, (start + n - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[b1] - self.offsets[b0]), int(self.offsets[b0]))
        base, parts = int(self.offsets[b0]), []
        for b in range(b0, b1):
            held = min(self.block, self.total - b * self.block)
            parts.append(unpack(raw[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], held, self.bits))
        return np.concatenate(parts)[start - b0 * self.block :][:n]


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Write all texts of `docs` as token-id files under `path`; the manifest: `shard`, `file`, `docs`, `ids`, `start`.

    Documents are range-partitioned by id, one file a partition. `start` counts
    the ids of all files before, from one row a file.
    """
    spark = docs.sparkSession
    out = path or fresh_path(spark, "tokens")
    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer, name = None, f"{shard:06d}-{uuid.uuid4().hex}.tok"
        enc = encoder(tokenizer, end_id)
        for b in trimmed(batches):
            if not b.num_rows:
                continue
            if writer is None:
                fs, root = _file_system(out)
                fs.create_dir(root, recursive=True)
                writer = Writer(fs.open_output_stream(posixpath.join(root, name)), bits_for(enc.size))
            for at, ids, counts in enc.stream(b.column(1), end=True):
                writer.add(b.column(0).slice(at, len(counts)).to_pylist(), ids, counts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{out}/{name}"], "docs": [len(writer.ids)], "ids": [writer.total]}, schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    manifest = materialise(ordered.mapInArrow(write, "shard long, file string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row a document, from the files: `doc_id`, `start`, `n_tokens`, and `ids`, its ids as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for b in trimmed(batches):
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _file_system(file)
                reader = Reader(fs.open_input_file(at))
                lo = 0
                while lo < len(reader.doc_ids):
                    hi = max(lo + 1, int(np.searchsorted(reader.firsts, reader.firsts[lo] + 500_000, "right")) - 1)
                    ids = reader.ids(int(reader.firsts[lo]), int(reader.firsts[hi] - reader.firsts[lo])).astype("<u4")
                    edge = reader.firsts[lo : hi + 1] - reader.firsts[lo]
                    values = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[lo:hi], mask=reader.nulls[lo:hi].astype(bool)), pa.array(reader.firsts[lo:hi] + start), pa.array(np.diff(edge)), values], schema=schema)
                    lo = hi

    files = manifest.select("file", "start")
    spread = files.repartition(min(max(files.count(), 1), 10_000), "file")  # a number of its own, so that small rows don't meet in one task
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6_bit_packed_tokens(spark, sf_dir: str) -> DataFrame:
    manifest = materialise(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "shards")
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
