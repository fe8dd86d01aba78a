"""Operator 9, token ids in binary files: one wavelet matrix per shard.

A shard file holds documents in ascending doc_id order: their ids (with an end id each) as a
wavelet matrix, that is one bit-plane for each bit of an id, most significant first, where
each plane's stable partition into zeros and ones gives the order of the next. Counts of
ones before each block of 512 bits are in the file too; they make rank constant-time and select a binary search,
so one file answers access, count and locate without being unpacked or scanned. Spark writes the files as
Parquet rows (payload, zstd) through its committer, so they can lie in any store and a lost
task leaves nothing half-written.

Null and empty texts hold the end id alone; repeated rows are written each; rows with null
doc_id come first; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import BATCH_BYTES, Scratch, encoder, read_table, slices, texts_of, tokenizer_path

MAGIC = b"WVMX0002"
HEAD = struct.Struct("<8sQQI")
BLOCK = 512
#: A shard ends with the document that brings it to so many tokens; the last of a partition may hold fewer.
SHARD_TOKENS = 1 << 20


class WaveletMatrix:
    """Succinct sequence of unsigned ids; all answers come from the bit-planes."""

    def __init__(self, n: int, planes: np.ndarray, before: np.ndarray):
        self.n, self.planes, self.before = n, planes, before  # planes: [levels, bytes], little bit order; before: ones before each block, and all
        self.levels = len(planes)
        self.zeros = n - before[:, -1].astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        width = -(-len(ids) // BLOCK) * BLOCK // 8
        planes = np.zeros((levels, width), np.uint8)
        for k in range(levels):
            bit = (ids >> np.uint16(levels - 1 - k) & np.uint16(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes[k, : len(packed)] = packed
            ids = np.concatenate([ids.take(np.flatnonzero(~bit)), ids.take(np.flatnonzero(bit))])
        ones = np.bitwise_count(planes.reshape(levels, -1, BLOCK // 8)).sum(2, dtype=np.uint64)
        return cls(len(ids), planes, np.concatenate([np.zeros((levels, 1), np.uint64), np.cumsum(ones, 1, dtype=np.uint64)], 1).astype("<u4" if len(ids) < 2**32 else "<u8"))

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane says how zeros and ones interleave."""
        ids = np.zeros(self.n, np.uint16)
        for k in reversed(range(self.levels)):
            bit, out = self._bits(k), np.empty(self.n, np.uint16)
            out[np.flatnonzero(~bit)] = ids[: self.zeros[k]]
            out[np.flatnonzero(bit)] = ids[self.zeros[k] :] | np.uint16(1 << (self.levels - 1 - k))
            ids = out
        return ids

    def rank1(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // BLOCK
        rest = self.planes[k, block * BLOCK // 8 : -(-i // 8)].copy()
        if len(rest) and i % 8:
            rest[-1] &= (1 << i % 8) - 1
        return int(self.before[k, block]) + int(np.bitwise_count(rest).sum())

    def select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) ``bit`` of plane k."""
        ones = self.before[k].astype(np.int64)
        count = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(count, j, side="right")) - 1
        piece = np.unpackbits(self.planes[k, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(piece == bit)[j - count[block]])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            ones = self.rank1(k, i)
            bit = int(self.planes[k, i // 8] >> (i % 8) & 1)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the first ``i`` places' copies of value end up after the last plane."""
        lo, hi = 0, i
        for k in range(self.levels):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            if value >> (self.levels - 1 - k) & 1:
                lo, hi = int(self.zeros[k]) + a, int(self.zeros[k]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, i: int | None = None) -> int:
        """Occurrences of value before place i (everywhere, if None)."""
        lo, hi = self._range(value, self.n if i is None else i)
        return hi - lo

    def locate(self, value: int, j: int) -> int:
        """Place of the j-th occurrence (from 0) of value."""
        at = self._range(value, 0)[0] + j
        for k in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - k) & 1
            at = self.select(k, bit, at - int(self.zeros[k]) if bit else at)
        return at


def dump(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    matrix = WaveletMatrix.build(ids, levels)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join((HEAD.pack(MAGIC, len(ids), len(docs), levels), docs.tobytes(), known.tobytes(), sizes.astype("<i8").tobytes(), matrix.before.tobytes(), matrix.planes.tobytes()))


def load(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, where each document starts (n+1 entries), and the matrix."""
    magic, n, docs, levels = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = HEAD.size
    ids = np.frombuffer(payload, "<i8", docs, at)
    known = np.frombuffer(payload, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(payload, "<i8", docs, at := at + docs)
    width, kind = -(-n // BLOCK) + 1, np.dtype("<u4" if n < 2**32 else "<u8")
    before = np.frombuffer(payload, kind, levels * width, at := at + 8 * docs).reshape(levels, width)
    planes = np.frombuffer(payload, np.uint8, offset=at + before.nbytes).reshape(levels, -1)
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], np.concatenate([[0], np.cumsum(sizes)]), WaveletMatrix(n, planes, before)


SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, levels: int = 16, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Shard rows of ``docs`` (doc_id, text); (part, seq) ascends with doc_id."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        docs, sizes, parts, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            payload = dump(docs, np.concatenate(sizes), np.concatenate(parts), levels)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(docs)], "n_tokens": [held], "payload": pa.array([payload], pa.binary())})

        for batch in slices(batches, "text", BATCH_BYTES):
            ids, off = encoder(tokenizer)(texts_of(batch))
            ids = np.insert(ids, off[1:], np.uint16(end_id))
            off += np.arange(len(off))
            own, at = batch.column("doc_id").to_pylist(), 0
            while at < len(own):
                to = min(int(np.searchsorted(off, off[at] + shard_tokens - held)), len(own))
                docs += own[at:to]
                sizes.append(np.diff(off[at : to + 1]))
                parts.append(ids[off[at] : off[to]])
                held += len(parts[-1])
                at = to
                if held >= shard_tokens:
                    yield shard()
                    docs, sizes, parts, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    # As many ranges as the input has splits, so a range is about a split's bytes whatever the session's setting.
    ranges = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(build, SHARDS)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each shard. Sums by part keep the only global window as short as the partitions are many."""
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("part_base"))
    own = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("in_part"))
    return own.join(parts, "part").select("part", "seq", (F.col("in_part") + F.col("part_base")).alias("base"))


DOCS = "part int, seq int, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c) for c in ("part", "seq", "payload")), strict=True):
                docs, off, matrix = load(payload.as_buffer())
                ids = matrix.decode().astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(off[:-1], pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(crc, pa.int64())],
                                                 ["part", "seq", "doc_id", "in_shard", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "seq", "payload").mapInArrow(unpack, DOCS)
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("in_shard") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = Scratch(spark, "token-files").table(token_shards(read_table(spark, sf_dir, "documents"), tokenizer_path()), "shards")
    return read_documents(shards)


QUERIES = {"op9_wavelet_token_files": op9_wavelet_token_files}
ORACLES: dict[str, str] = {}
