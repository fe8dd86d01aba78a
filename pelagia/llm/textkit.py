"""Shared helpers of the corpus operators: scratch tables, batching, words, hashes, token ids.

Everything here works on one Arrow batch or one table at a time; the operators
decide how Spark partitions the work.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step inside a task handles at a time.
SLICE_BYTES = 2 << 20

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one run, written below ``spark.checkpoint.dir`` (shared by driver and executors).

    A written table cuts lineage: a lost executor costs only the tasks that it ran. Tables go when Spark ends.
    Where the setting is absent a local session uses a temporary folder of its own; a cluster has to name a shared one.
    """

    cleaned = 0.0

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{os.path.join(tempfile.gettempdir(), 'pelagia-scratch')}"
            spark.sparkContext.setCheckpointDir(base)
        bound_batches(spark)
        self.spark = spark
        self.root, self.tables = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        jvm = self.spark.sparkContext._jvm
        if time.monotonic() - Scratch.cleaned > 5:  # Spark's cleaner drops shuffle files of finished jobs only once the driver has let go of them
            jvm.System.gc()
            Scratch.cleaned = time.monotonic()
        if not self.tables:
            root = jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.tables += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch between Spark and Python; rows may hold long texts.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at BATCH_BYTES unless the session asks for less, in plain bytes."""
    told = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not told.rstrip("bB").isdigit() or not 0 < int(told.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text in each piece is about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (maximal runs free of ASCII white space) and, per text, where its words start; n+1 entries."""
    lists = pc.ascii_split_whitespace(texts)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if full.all():
        return flat, off
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[off]


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out; else as good as random."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h = h ^ (h >> np.uint64(27))
    h = h * M2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each different word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    each = pd.util.hash_array(np.asarray(coded.dictionary.to_pylist(), dtype=object), categorize=False)
    return mix(each.astype(np.uint64))[coded.indices.to_numpy()]


#: Odd multiplier of window hashes; its powers weigh the words by place.
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours, without regard to text ends; ``len - size + 1`` values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = hashes[:n].copy(), BASE
    for k in range(1, size):
        out += hashes[k : k + n] * power
        power = np.uint64(int(power) * int(BASE) & (2**64 - 1))
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def grouped_distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each group and their new offsets. Groups are slices of ``values``."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    new = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]) if parts else np.zeros(1, np.int64)
    return (np.concatenate(parts) if parts else values[:0]), new


def list_array(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


#: A letter with a punctuation mark after it: always an end of a pre-token, apart from apostrophes. The marks are told one by one, as what is no
#: letter to one version of Unicode may be one to the tokenizer's.
_EDGE = r"(\pL)([!-&(-/:-@\[-`{-~«»“”„…–—])"


@cache
def _odd() -> str:
    """Texts that are left whole between blanks: those with marks (which may compose with letters), with letters that the
    tokenizer's normalisation (NFC, lower case) turns into letters and marks, or with its special strings."""
    change = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and any(unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFC", c).lower())]
    return rf"\pM|<\||\|>|[{''.join(change)}]"


class WordEncoder:
    """Token ids of whole texts, as the tokenizer gives them.

    ``word_bpe_49k.json`` drops white space and merges inside pre-tokens only, so the ids of a
    text are those of its pieces, one after another, however it is cut at blanks, newlines and
    ends of pre-tokens. Each piece is encoded by the tokenizer once and kept; beyond ``keep``
    pieces (or 32 bytes for each of them) only those of the latest texts stay. Pieces whose
    lower case normalisation leaves alone (Latin letters) go to the tokenizer's model at once,
    all others through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.to_bytes = {c: to_bytes(chr(c))[0][0] for c in range(0x80, 0x250) if chr(c).isalpha()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.held = packed_ids([]), 0  # ids of each known piece, as bytes; bytes of the pieces

    @staticmethod
    def pieces(texts: pa.Array) -> pa.ListArray:
        if not pc.any(pc.match_substring_regex(texts, _odd())).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=_EDGE, replacement=r"\1 \2")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def ids_of(self, new: list[str]) -> list[list[int]]:
        out: list = [None] * len(new)
        rest = []
        direct, normal, to_bytes = self.tokenizer.model.tokenize, unicodedata.is_normalized, self.to_bytes
        for k, w in enumerate(new):
            low = w.lower() if w.isalpha() else ""
            if low and w.isascii():
                out[k] = [t.id for t in direct(low)]
            elif low and max(low) < "\u0250" and low.isalpha() and normal("NFC", w):
                out[k] = [t.id for t in direct(low.translate(to_bytes))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and, per text, where its ids start; n+1 entries."""
        lists = self.pieces(texts)
        coded, off = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [words[k] for k in fresh.tolist()]
            more = packed_ids(self.ids_of(new))
            at[fresh] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, at[fresh].tolist(), strict=True))
            self.pool = pa.concat_arrays([self.pool, more])
            self.held += pc.sum(pc.binary_length(coded.dictionary.take(pa.array(fresh)))).as_py()
        own = self.pool.take(pa.array(at))
        if self.full():
            self.known, self.pool, self.held = dict(zip(words, range(len(words)), strict=True)), own, pc.sum(pc.binary_length(coded.dictionary)).as_py()
            if self.full():
                self.clear()
        if not len(coded):
            return np.zeros(0, np.uint16), off - off[0]
        _, places, ids = own.take(coded.indices).buffers()
        word_ends = np.frombuffer(places, np.int64, len(coded) + 1) // 2
        return np.frombuffer(ids or b"", np.uint16, word_ends[-1]), word_ends[off - off[0]]

    def full(self) -> bool:
        return len(self.known) > self.keep or self.held > 32 * self.keep


def packed_ids(ids: list[list[int]]) -> pa.Array:
    """Each list of ids as the bytes of 16-bit numbers."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint16, int(sizes.sum()))
    places = np.concatenate([np.zeros(1, np.int64), np.cumsum(2 * sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(places), pa.py_buffer(flat)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of an id table that may be broadcast: 8 bytes each, counted before.
BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, how: str, column: str | list[str] = "doc_id") -> DataFrame:
    """``left_semi`` or ``left_anti`` join with a written table of ids; it is broadcast only if a count shows it to be small."""
    from pyspark.sql import functions as F

    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)
