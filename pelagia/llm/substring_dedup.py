"""Operator 8, substring removal by recompression.

Rounds of recompression name runs and pairs of names: a run of one name becomes a name of its own, then a name on the left
side of a (hashed) split of all names joins a neighbour on the right side. A name's id is a hash of what it joins, so all
tasks give equal passages equal names without an exchange, but for a few at their edges; each name carries the words that
it depends on. Two rounds run inside the tasks that read the texts: there every word would have to move twice a round.
The rounds after them are Spark's, on what is left:

1. Of every window of ``window`` words the name with the smallest hash among those that depend on nothing outside is its
   anchor, the same in equal windows (windows without one, inside long runs, are their own). Spark counts the anchors of all
   texts; those that occur once take part no longer. Whole copies of texts are settled by a hash of all their words before.
2. What an anchor's neighbouring windows reach together is its passage. Spark names passages globally, a table of (anchor, 128 bits
   of all words) with the first place of each. Any later place of a passage is a verified repeat of all of it, however
   many windows it has.
3. Equal windows have equal anchors, so only the passages of an anchor that has several can still share windows: their first
   places alone give a row a window, and the first place of each window keeps its words.

Texts with such repeats are read once more to drop the words. Counts and first places are combined in the map tasks before
rows move, and joins have one row a key on one side, so Spark can split hot keys. Words are compared by 128-bit hashes of
passages and windows. Null texts have no words; rows with null doc_id neither remove nor are removed; of rows that share a
doc_id none is earlier than another at the same start; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import BASE, Scratch, by_ids, list_array, mix, read_table, signed, slices, split_words, texts_of, window_hashes, word_hashes

WINDOW, ROUNDS = 20, 2
LEFT, RIGHT, RUN_SALT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Names:
    """Names of all words of a batch, with the words [low, high) that each depends on. Texts don't mix."""

    def __init__(self, hashes: np.ndarray, off: np.ndarray):
        n = len(hashes)
        self.name, self.low, self.high = hashes.copy(), np.arange(n), np.arange(1, n + 1)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def _merge(self, joins: np.ndarray, name_of) -> None:
        """Join each name with the one before it where ``joins`` says so; neighbours' words are depended on, and so is the edge of the text."""
        n = len(self.name)
        head = np.flatnonzero(~joins)
        last = np.append(head[1:], n) - 1
        edge = np.int64(1) << 60
        before = np.where((head > 0) & (self.text[head] == self.text[head - 1]), self.low[head - 1], -edge)
        after_at = np.minimum(last + 1, n - 1)
        after = np.where((last + 1 < n) & (self.text[last] == self.text[after_at]), self.high[after_at], edge)
        name = name_of(head, last)
        self.name, self.text, self.low, self.high = name, self.text[head], before, after

    def round(self, number: int) -> None:
        if len(self.name) < 2:
            self.low, self.high = np.full(len(self.name), -(1 << 60)), np.full(len(self.name), 1 << 60)
            return
        same_text = np.append(False, self.text[1:] == self.text[:-1])
        runs = np.append(False, self.name[1:] == self.name[:-1]) & same_text
        if runs.any():
            low, high = self.low, self.high
            head = np.flatnonzero(~runs)
            last = np.append(head[1:], len(runs)) - 1
            size = (last - head).astype(np.uint64)
            # A run ends where another name starts: one name on each side is depended on.
            n = len(runs)
            edge = np.int64(1) << 60
            before = np.where((head > 0) & same_text[head], low[head - 1], -edge)
            nxt = np.minimum(last + 1, n - 1)
            after = np.where((last + 1 < n) & same_text[nxt], high[nxt], edge)
            self.name = np.where(size > 0, mix(self.name[head] * RUN_SALT + size), self.name[head])
            self.low, self.high = np.minimum(before, low[head]), np.maximum(after, high[last])
            self.text = self.text[head]
            same_text = same_text[head]
        else:
            n = len(self.name)
            edge = np.int64(1) << 60
            before = np.where(same_text, np.append(0, self.low[:-1]), -edge)
            after = np.where(np.append(same_text[1:], False), np.append(self.high[1:], 0), edge)
            self.low, self.high = np.minimum(before, self.low), np.maximum(after, self.high)
        side = (mix(self.name + np.uint64(number)) & np.uint64(1)).astype(bool)
        joins = np.append(False, ~side[:-1] & side[1:]) & same_text
        salt = mix(np.array([number + 1], np.uint64))[0]

        def name_of(head: np.ndarray, last: np.ndarray) -> np.ndarray:
            return np.where(last > head, mix(self.name[head] * LEFT + self.name[last] * RIGHT + salt), self.name[head])

        self._merge(joins, name_of)


def spans(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the words [low, high), from sums of place-weighted hashes before each place."""
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    up, down = np.full(len(hashes), BASE), np.full(len(hashes) + 1, inverse)
    up[:1], down[0] = 1, 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * np.cumprod(up))])
    return mix((total[high] - total[low]) * np.cumprod(down)[low] + (high - low).astype(np.uint64))


def anchors(hashes: np.ndarray, off: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every full window, in order: its first word, its anchor's hash and an id of the anchor's place (windows that share one share the id)."""
    count = np.diff(off)
    per = np.maximum(0, count - window + 1)
    start = np.arange(int(per.sum())) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    names = Names(hashes, off)
    for k in range(rounds):
        names.round(k)
    # low and high ascend within and across texts once edges of texts are set to places that no window reaches.
    low = np.where(names.low < -1, off[names.text] - 1, names.low)
    high = np.where(names.high > off[-1], off[names.text + 1] + 1, names.high)
    first, end = np.searchsorted(low, start, side="left"), np.searchsorted(high, start + window, side="right")
    size = end - first
    # What tells a name from others is all that it depends on; one that reaches over an edge is never an anchor.
    key = mix(names.name ^ spans(hashes, np.clip(names.low, 0, len(hashes)), np.clip(names.high, 0, len(hashes))))
    hit = size > 0
    place = np.full(len(start), -1)
    if hit.any():
        levels = [np.arange(len(key))]
        while (2 << (len(levels) - 1)) <= int(size.max()):
            a, step = levels[-1], 1 << (len(levels) - 1)
            x, y = a[:-step], a[step:]
            levels.append(np.where(key[x] <= key[y], x, y))
        level = np.zeros(len(start), np.int64)
        level[hit] = np.floor(np.log2(size[hit])).astype(np.int64)
        for k, table in enumerate(levels):
            at = np.flatnonzero(hit & (level == k))
            x, y = table[first[at]], table[end[at] - (1 << k)]
            place[at] = np.where(key[x] <= key[y], x, y)
    anchor = np.empty(len(start), np.uint64)
    anchor[hit] = key[place[hit]]
    if not hit.all():
        anchor[~hit] = mix(window_hashes(hashes, window)[start[~hit]] + RUN_SALT)
        place[~hit] = len(key) + start[~hit]
    return start, anchor, place


def joined(texts: pa.Array) -> list[bytes]:
    """Words of each text, joined by one space, as UTF-8."""
    return pc.binary_join(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts)), " ").cast(pa.binary()).to_pylist()


#: anchors: each once; inner: those that the text has at two places or more.
FIRST = "doc_id long, n_words long, sha string, tag long, anchors array<long>, inner array<long>"


def first_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            texts = texts_of(batch)
            words, off = split_words(texts)
            h = word_hashes(words)
            start, anchor, place = anchors(h, off, window)
            new = np.append(True, place[1:] != place[:-1])[: len(place)]
            text = np.searchsorted(off, start[new], side="right") - 1
            tagged = anchor[new] + mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))[text]
            _, at, times = np.unique(tagged, return_index=True, return_counts=True)

            def lists(at: np.ndarray) -> pa.Array:
                at = np.sort(at)  # noqa: B023
                return list_array(signed(anchor[new][at]), np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=batch.num_rows))]), pa.int64())  # noqa: B023

            sha = [hashlib.sha256(x).hexdigest() for x in joined(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(sha, pa.string()), pa.array(text_tags(h, off)), lists(at), lists(at[times > 1])], ["doc_id", "n_words", "sha", "tag", "anchors", "inner"])

    return run


def text_tags(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of all words of each text: rows of one doc_id may hold different texts."""
    return signed(spans(h, off[:-1], off[1:]))


def in_text(off: np.ndarray, rows: np.ndarray, tags: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first word in the batch, number of windows) of the spans of each row's own text."""
    flat = lists.flatten()
    own = np.repeat(rows, pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    start, n, tag = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    mine = tag == tags[own]
    return (start + off[own])[mine], n[mine]


PASSAGES = "anchor long, c1 long, c2 long, doc_id long, start int, n int, tag long"


def passages(window: int):
    """Of texts with their repeated anchors: each place of such an anchor with a name for all that its ``n`` windows from ``start`` on hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, off = split_words(texts_of(batch))
            h = word_hashes(words)
            start, anchor, place = anchors(h, off, window)
            head = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
            n = np.diff(np.append(head, len(place)))
            start, anchor = start[head], anchor[head]
            text = np.searchsorted(off, start, side="right") - 1
            lists = batch.column("again")
            again, rows = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            tag = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))
            keep = np.isin(anchor + tag[text], again.view(np.uint64) + tag[rows])
            start, anchor, n, text = start[keep], anchor[keep], n[keep], text[keep]
            end = start + n + window - 1
            c1, c2 = spans(h, start, end), spans(mix(h ^ RUN_SALT), start, end)
            columns = [*(pa.array(signed(x)) for x in (anchor, c1, c2)), batch.column("doc_id").take(pa.array(text)), pa.array(start - off[text], pa.int32()), pa.array(n, pa.int32()), pa.array(text_tags(h, off)[text])]
            yield pa.RecordBatch.from_arrays(columns, [x.strip().split(" ")[0] for x in PASSAGES.split(",")])

    return run


def windows_of(window: int):
    """Of texts with the places of passages: each window in them, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, off = split_words(texts_of(batch))
            h = word_hashes(words)
            tags = text_tags(h, off)
            first, n = in_text(off, np.arange(batch.num_rows), tags, batch.column("places"))
            start = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            text = np.searchsorted(off, start, side="right") - 1
            w1, w2 = window_hashes(h, window)[start], window_hashes(mix(h ^ RUN_SALT), window)[start]
            yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), batch.column("doc_id").take(pa.array(text)), pa.array(start - off[text], pa.int32()), pa.array(tags[text])], ["w1", "w2", "doc_id", "start", "tag"])

    return run


def drop_words(window: int):
    """Of texts with the spans of windows that begin earlier elsewhere: what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, off = split_words(texts_of(batch))
            n, h = np.diff(off), word_hashes(words)
            edge, tags = np.zeros(len(h) + 1, np.int64), text_tags(h, off)
            first, many = in_text(off, np.arange(batch.num_rows), tags, batch.column("marks"))
            np.add.at(edge, first, 1)
            np.add.at(edge, first + many + window - 1, -1)
            removed = np.cumsum(edge)[:-1] > 0
            kept = words.filter(pa.array(~removed))
            total = np.concatenate([[0], np.cumsum(~removed)])[off]
            out = pc.binary_join(pa.ListArray.from_arrays(pa.array(total, pa.int32()), kept), " ").to_pylist()
            sha = [hashlib.sha256((x or "").encode()).hexdigest() for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(total), pa.int64()), pa.array(sha, pa.string()), pa.array(out, pa.string()), pa.array(tags)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "tag"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs`` (doc_id, text); with ``texts`` also the kept words."""
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.table(docs.mapInArrow(first_pass(window), FIRST), "first")
    rows = scratch.table(first.drop("anchors", "inner"), "rows")
    full = first.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    row = ["doc_id", "tag"]  # rows that share a doc_id may hold different texts
    # Minima and counts are written before they are joined: Spark splits hot keys only where both sides come straight from a shuffle.
    firsts = scratch.table(full.groupBy("sha", "n_words").agg(F.min("doc_id").alias("doc")), "firsts")
    copies = scratch.table(full.select("doc_id", "tag", "sha", "n_words").join(firsts, ["sha", "n_words"]).where("doc_id > doc").select(*row).distinct(), "copies")

    own = by_ids(full.select(*row, "anchors", "inner"), copies, "left_anti", row).select("doc_id", F.explode(F.concat("anchors", "inner")).alias("anchor"))
    twice = scratch.table(own.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "twice")
    again = scratch.table(own.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("again")), "again")
    ids = scratch.table(again.select("doc_id"), "again-ids")
    scratch.drop("first")
    suspects = scratch.table(by_ids(docs, ids, "left_semi").join(again, "doc_id"), "suspects")

    held = scratch.table(suspects.mapInArrow(passages(window), PASSAGES), "passages")
    key, place = ["anchor", "c1", "c2"], F.struct("doc_id", "start", "n", "tag")
    named = scratch.table(held.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")), "named")
    again = held.join(named.where("k > 1").select(*key, "first.doc_id", "first.start").toDF(*key, "__doc", "__start"), key)
    later = again.where("doc_id > __doc or doc_id = __doc and start > __start").select("doc_id", "start", "n", "tag")

    several = scratch.table(named.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "several")
    open_ = named.select("anchor", "first.*").join(several, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "tag")).alias("places"))
    windows = suspects.select("doc_id", "text").join(scratch.table(open_, "open"), "doc_id")
    windows = scratch.table(windows.mapInArrow(windows_of(window), "w1 long, w2 long, doc_id long, start int, tag long"), "windows")
    first_at = scratch.table(windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("w1", "w2", "first"), "first-at")
    single = windows.join(first_at, ["w1", "w2"]).where("doc_id > first.doc_id or doc_id = first.doc_id and start > first.start").select("doc_id", "start", F.lit(1).alias("n"), "tag")
    marks = scratch.table(later.unionByName(single).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "tag")).alias("marks")), "marks")
    scratch.drop("windows", "passages", "named")
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, tag long"
    done = suspects.select("doc_id", "text").join(marks, "doc_id", "left").mapInArrow(drop_words(window), kept)

    nothing = hashlib.sha256(b"").hexdigest()
    out = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    whole = by_ids(by_ids(rows, ids, "left_anti"), copies, "left_anti", row).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    gone = by_ids(rows, copies, "left_semi", row).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(nothing).alias("kept_sha256"))
    done = by_ids(done, copies, "left_anti", row)
    if not texts:
        return whole.unionByName(gone).unionByName(done.select(*out))
    no_marks = F.array().cast("array<struct<start:int,n:int,tag:bigint>>").alias("marks")
    plain = by_ids(by_ids(docs, ids, "left_anti").select("doc_id", "text", no_marks).mapInArrow(drop_words(window), kept), copies, "left_anti", row)
    return plain.select(*out, "kept").unionByName(gone.withColumn("kept", F.lit(""))).unionByName(done.select(*out, "kept"))


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read_table(spark, sf_dir, "documents"))


SQL = """with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
h as (select doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) k from (select doc_id, w, unnest(range(1, len(w) - 18)) s from d where len(w) >= 20)),
m as (select doc_id, s from (select *, row_number() over (partition by k order by doc_id, s) r from h) where r > 1),
c as (select distinct doc_id, unnest(range(s, s + 20)) i from m),
k as (select p.doc_id, string_agg(word, ' ' order by i) t, count(*) n from (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from d) p anti join c on c.doc_id = p.doc_id and c.i = p.i group by p.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (doc_id)"""

QUERIES = {"op8_recompression_dedup": op8_recompression_dedup}
ORACLES = {"op8_recompression_dedup": SQL}
