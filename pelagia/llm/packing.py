"""Operator 1, best-fit packing by the sum-of-squares rule.

Each document (its token ids and an end id) goes into sequences of at most ``capacity``
tokens; only documents longer than that are cut. A piece of size s is put where the sum of
squares of N(g), the count of open sequences with a gap of g tokens, becomes smallest.

Each task packs what it has encoded, longest pieces first, so the first round moves no rows.
Sequences that it leaves more than ``slack`` tokens short are dissolved, and their pieces are
packed once more in shards of up to ``shard_rows`` pieces from all tasks.

Null and empty texts are documents of one end id; repeated rows are packed each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import Scratch, encoder, read_table, slices, texts_of, tokenizer_path

CAPACITY = 4096


class SumOfSquares:
    """Places sizes one at a time; ``bin`` and ``offset`` of each are final at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        never = -(1 << 29)
        # after[g]: what an open sequence more with gap g adds; full sequences don't count.
        self.after = np.ones(capacity + 1, np.int32)
        self.after[0] = 0
        # before[g]: what one less with gap g takes away, plus 2; a new sequence takes nothing.
        self.before = np.full(capacity + 1, never, np.int32)
        self.before[capacity] = 2
        self.never = never
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``size``; ties go to the smallest gap."""
        change = self.after[: self.capacity - size + 1] - self.before[size:]
        gap = size + int(change.argmin())
        if gap == self.capacity:
            at, self.bins = self.bins, self.bins + 1
        else:
            at = self.open[gap].pop()
            self.after[gap] -= 2
            self.before[gap] = self.after[gap] if self.open[gap] else self.never
        if left := gap - size:
            self.open[left].append(at)
            self.after[left] += 2
            self.before[left] = self.after[left]
        return at, self.capacity - gap


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and the sequence's final fill for each size, placed in falling order of size."""
    packer = SumOfSquares(capacity)
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        at[k], offset[k] = packer.place(int(sizes[k]))
    fill = np.bincount(at, weights=sizes, minlength=1).astype(np.int64)
    return at, offset, fill[at] if len(sizes) else at


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", part long, bin long, offset long, fill long"
PLACED_ARROW = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "fill")])


def _place(pieces: dict, capacity: int, part: int) -> Iterator[pa.RecordBatch]:
    at, offset, fill = pack_sizes(np.asarray(pieces["length"], np.int64), capacity)
    columns = pieces | {"part": np.full(len(at), part), "bin": at, "offset": offset, "fill": fill}
    yield from pa.table([pa.array(columns[f.name], f.type) for f in PLACED_ARROW], schema=PLACED_ARROW).to_batches(50_000)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1,
                   slack: int = 16, shard_rows: int = 50_000) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ``sequence_id`` and ``offset``."""
    scratch = Scratch(spark, "packing")

    def encode_and_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, piece, start, length, crc = [], [], [], [], []
        for batch in slices(batches, "text"):
            ids, off = encoder(tokenizer)(texts_of(batch))
            for d, a, b in zip(batch.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint16(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    cut = own[s : s + capacity]
                    for to, x in ((doc, d), (piece, k), (start, s), (length, len(cut)), (crc, zlib.crc32(cut.tobytes()))):
                        to.append(x)
        yield from _place({"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}, capacity, TaskContext.get().partitionId())

    def place_again(batches: Iterator[pa.RecordBatch], part: int = 0) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if table is not None:
            yield from _place({c: table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, capacity, part)

    def place_shard(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(place_again(table.to_batches(), key[0].as_py()), schema=PLACED_ARROW)

    first = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode_and_place, PLACED), "placed")
    tight = F.col("fill") >= capacity - slack
    short = first.where(~tight).select("doc_id", "piece", "start", "length", "ids_crc32")
    shards = -(-short.count() // shard_rows)
    if shards <= 1:
        again = short.coalesce(1).mapInArrow(place_again, PLACED)
    else:
        again = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInArrow(place_shard, PLACED)
    number = F.shiftleft(F.col("part"), 32) + F.col("bin")
    out = ("doc_id", "piece", "start", "length", "ids_crc32")
    return first.where(tight).select(*out, number.alias("sequence_id"), "offset").unionByName(
        again.select(*out, (number + F.lit(1 << 62)).alias("sequence_id"), "offset"))


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, read_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_sum_of_squares_packing": op1_sum_of_squares_packing}
ORACLES: dict[str, str] = {}
