"""Operator 12, periodic runs of words from the longest-previous-factor array.

A run is a stretch of words that repeats with a smallest period q at least twice, is ``least`` words long or longer and
cannot be extended. Texts are independent: Spark deals them to tasks, and each task takes a slice of texts at a time:

1. Names of all stretches of 1, 2, 4, ... words (prefix doubling, which sorts only what is not yet told apart) end as the
   suffix array. They also give the common words of any two places, forwards or backwards, so the LCP array as well.
2. The longest previous factor of each place is the larger of the LCP minima to the nearest earlier place on both sides of
   the suffix array, found by jumps over what lies between. It gives the Lempel-Ziv blocks.
3. A run that crosses or touches a boundary between two blocks has a period below the sum of their lengths (Main): each
   boundary and period is extended in both directions. A run strictly inside a block is a copy of one inside the block's
   earlier occurrence: runs in buckets by start are copied from left to right.

Work is n log n a text whatever it repeats; memory is that of a slice, or of one text where that is longer. Null and empty
texts have no words and no runs; repeated rows are each looked at; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import WORD_PATTERN, list_array, read_table, slices, split_words, texts_of

LEAST = 12
#: Pairs of places compared at a time.
CHUNK = 1 << 21
OUT = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def stretch_names(codes: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Level k names the 2^k words from each place on, the same only for equal stretches of one text; one past the end is -1. The last level ranks all suffixes."""
    n = len(codes)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = off[1:][text]
    active, key = np.arange(n), text * (int(codes.max(initial=0)) + 1) + codes
    base, out = np.zeros(n, np.int64), []
    names = np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        active, key, base = active[order], key[order], base[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        fresh = np.append(True, base[1:] != base[:-1])[: len(key)]
        at = np.arange(len(key))
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        names = names.copy()
        names[active] = base + np.maximum.accumulate(np.where(new, at, 0)) - head
        out.append(np.append(names, -1).astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        active = np.sort(active[np.repeat(size > 1, size)])
        if not len(active):
            return out
        ahead = active + (1 << (len(out) - 1))
        second = np.where(ahead < end[active], names[np.minimum(ahead, n - 1)] + 1, 0)
        base = names[active]
        key = base * (n + 1) + second


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Words that are the same from places i < j of one text on, or before them if ``back``."""
    last = len(levels[0]) - 1

    def same(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if back:
            a, b = a - (1 << k), b - (1 << k)
            return (a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])
        return levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]

    top, rest, k = np.full(len(i), -1), np.arange(len(i)), 0
    while k < len(levels) and len(rest):
        rest = rest[same(k, i[rest], j[rest])]
        top[rest] = k
        k += 1
    out = np.where(top >= 0, 1 << np.maximum(top, 0), 0)
    for k in range(int(top.max(initial=0)) - 1, -1, -1):
        rest = np.flatnonzero(top > k)
        gone = -out[rest] if back else out[rest]
        out[rest[same(k, i[rest] + gone, j[rest] + gone)]] += 1 << k
    return out


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each place, the length of the longest factor from there on that also starts earlier in its text, and such a start."""
    rank = levels[-1][:-1].astype(np.int64)
    n = len(rank)
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = common(levels, np.minimum(sa[:-1], sa[1:]), np.maximum(sa[:-1], sa[1:]))
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for step, least in ((-1, lcp[:n].copy()), (1, lcp[1:].copy())):
        other = np.clip(np.arange(n) + step, 0, n - 1)  # everything between a place and its other starts later than it
        open_ = np.flatnonzero((least > 0) & (sa[other] > sa))
        while len(open_):
            via = other[open_]
            shared, beyond = np.minimum(least[open_], least[via]), other[via]
            least[open_], other[open_] = shared, beyond
            open_ = open_[(shared > 0) & (sa[beyond] > sa[open_])]
        better = least > length[sa]
        length[sa[better]], source[sa[better]] = least[better], sa[other[better]]
    return length, source


def boundary_runs(levels: list[np.ndarray], off: np.ndarray, start: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that cross or touch an end of a block, each once with its smallest period."""
    text = np.searchsorted(off, start, side="right") - 1
    inner = np.append(False, text[1:] == text[:-1])
    lasts = np.append(~inner[1:], True)
    at = np.concatenate([start[inner], (start + size)[lasts]])
    most = np.concatenate([(size + np.append(0, size[:-1]))[inner] - 1, size[lasts]])
    text = np.concatenate([text[inner], text[lasts]])
    low, high = off[text], off[text + 1]
    pair = levels[min(1, len(levels) - 1)]
    part = np.cumsum(most) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = np.repeat(np.arange(a, b), most[a:b])
        period = np.arange(1, len(own) + 1) - np.repeat(np.cumsum(most[a:b]) - most[a:b], most[a:b])
        for i in (at[own], at[own] - period):
            j = i + period
            inside = np.flatnonzero((i >= low[own]) & (j <= high[own]))
            i, j = i[inside], j[inside]
            # Three words at least are shared around i and j, so two on one side.
            hit = (pair[i] == pair[j]) | ((i >= 2) & (pair[np.maximum(i - 2, 0)] == pair[np.maximum(j - 2, 0)]))
            i, j = i[hit], j[hit]
            after, before = common(levels, i, j), common(levels, i, j, back=True)
            good = after + before >= np.maximum(j - i, least - (j - i))
            found.append(np.stack([i - before, j + after, j - i], 1)[good])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))[: len(rows)]]


def runs_of(codes: np.ndarray, off: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of texts whose words are ``codes`` (text t: off[t] to off[t + 1]), by start, then period."""
    if not len(codes):
        return np.zeros((0, 3), np.int64)
    if least < 5:
        raise ValueError("runs have five words at least")
    levels = stretch_names(codes, off)
    length, source = previous_factors(levels)
    start, at, steps = [], 0, np.maximum(length, 1).tolist()
    while at < len(steps):
        start.append(at)
        at += steps[at]
    start = np.array(start)
    size = np.diff(np.append(start, len(steps)))
    rows = boundary_runs(levels, off, start, size, least)
    long = np.flatnonzero(size >= least + 2)
    if len(rows) and len(long):
        buckets: dict[int, list[tuple[int, int]]] = {}
        for first, end, period in rows.tolist():
            buckets.setdefault(first, []).append((end, period))
        copied = []
        for block, many in zip(start[long].tolist(), size[long].tolist(), strict=True):
            origin = int(source[block])
            shift, stop = block - origin, origin + many
            for first in range(origin + 1, stop - least):
                for end, period in buckets.get(first, ()):
                    if end < stop:
                        copied.append((first + shift, end + shift, period))
                        buckets.setdefault(first + shift, []).append((end + shift, period))
        if copied:
            rows = np.concatenate([rows, np.array(copied)])
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; word numbers from 0) and collapsed of each row of ``docs`` (doc_id, text):
    the words, joined by one space, without those that a run repeats after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, off = split_words(texts_of(batch))
            codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
            rows = runs_of(codes, off, least)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 1], -1)
            kept = np.cumsum(change)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(kept)])[off]
            text = np.searchsorted(off, rows[:, 0], side="right") - 1
            each = pa.StructArray.from_arrays([pa.array(rows[:, 0] - off[text]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])], ["start", "length", "period"])
            bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=batch.num_rows))])
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(total, pa.int32()), words.filter(pa.array(kept))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), list_array(each, bounds, each.type), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where a tenth of the texts, told by the crc32 of their doc_id, repeat a stretch of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(z: Column) -> Column:
        w, n, g = z["w"], F.size(z["w"]).cast("long"), z["g"]
        at = F.pmod(g, n)
        period = 1 + F.floor((n - at) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - at - 1), lambda k: F.get(w, (at + k % period).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), at.cast("int")), tail), " ")

    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    planted = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), repeated)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(WORD_PATTERN), planted).otherwise(F.col("text")).alias("text"))


def op12_lpf_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.length")).alias("length"), "best.period",
                        F.floor(-1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: DuckDB's crc32 of a list of byte values, from its table of 256 remainders. Fixed value: the polynomial, reflected.
CRC_TABLE = "(select list(list_reduce(range(9), lambda c, k: case when k = 0 then c when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) order by i) t from range(256) r(i))"


def crc_sql(values: str, table: str) -> str:
    return f"xor(4294967295, list_reduce({values}, lambda c, x: xor({table}[xor(c & 255, x) + 1], c >> 8), 4294967295))"


SQL = f"""with crc as {CRC_TABLE},
o as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w,
             {crc_sql("list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(unicode(x) as bigint))", "t")} h from documents, crc),
g as (select *, len(w) n, h // 10 g from o),
a as (select *, case when n > 0 then g % n end a, case when n > 0 then 1 + (n - g % n) // (3 + g % 8) end p from g),
d as (select rid, doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) else w end w from a),
x as (select rid, unnest(w) word, generate_subscripts(w, 1) - 1 i from d),
e as (select l.rid, r.i - l.i q, l.i from x l join x r on l.rid = r.rid and l.word = r.word and l.i < r.i),
s as (select rid, q, min(i) st, count(*) k from (select *, i - row_number() over (partition by rid, q order by i) part from e) group by rid, q, part having count(*) >= greatest(q, {LEAST} - q)),
r as (select rid, st, k + q len, min(q) q from s group by all),
b as (select rid, string_agg(st || ',' || len || ',' || q || chr(10), '' order by st, q) told, count(*) n_runs, first(st order by len desc, st, q) bs, first(len order by len desc, st, q) bl, first(q order by len desc, st, q) bq from r group by rid),
c as (select distinct rid, unnest(range(st + q, st + len)) i from r),
k as (select rid, string_agg(word, ' ' order by i) t from x anti join c using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0) n_runs, cast(bs as bigint) "start", cast(bl as bigint) "length", cast(bq as bigint) "period", cast(1000 * bl // bq as bigint) exponent_milli,
       sha256(coalesce(told, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256 from d left join b using (rid) left join k using (rid)"""

QUERIES = {"op12_lpf_periodic_runs": op12_lpf_periodic_runs}
ORACLES = {"op12_lpf_periodic_runs": SQL}
