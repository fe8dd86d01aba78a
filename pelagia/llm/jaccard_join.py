"""Operator 5, n-gram Jaccard join with adaptive multi-match prefixes.

Texts become sets of hashed word shingles; equal sets form a class with one representative.
All tokens have one global order: those that the corpus counts find often come last, by count.
Every set posts a prefix of its tokens in that order. With p tokens of n posted, two sets that
link share at least a = ceil(t (n1 + n2) / (1 + t)) tokens and so at least
min(p1 - n1 + a, p2 - n2 + a) tokens of their prefixes. p is the shortest length for which this
is 1 for any partner, lengthened by as much as brings the estimated cost (postings read, plus
candidates verified, which fall with the matches required) to its minimum.

Runs of up to ``run`` postings of a token give their pairs at once. In longer runs neighbours of
random orders are linked first; then sets outside the run's largest component meet all sets of the
run, block by block on both sides, so no link between components is missed and none inside is looked for. That is done
twice: first each set takes its best candidate of every other component in a block, which brings
most of a group together; then those that are still apart take all. Candidates are verified on
their whole sets. Components come from alternating stars.

Null and empty texts have no shingles and link with nothing; rows with null doc_id get no
component; rows that share a doc_id are one node with all their texts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components, merged
from .textkit import Scratch, by_ids, grouped_distinct, list_array, mix, read_table, signed, slices, split_words, texts_of, window_hashes, word_hashes

#: Tokens kept as often seen, at most; 8 bytes each reach every task.
OFTEN = 1 << 18
#: Shingles counted together inside a task.
CHUNK = 2 << 20
RUN, BLOCK, VERIFY_COST = 64, 1024, 20
EXTENSIONS = (0, 2, 4, 8, 16)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles. A text of fewer words is one shingle."""
    words, off = split_words(pc.ascii_lower(texts))
    h = word_hashes(words)
    count = np.diff(off)
    n = np.where(count >= size, count - size + 1, 0)
    start = np.concatenate([[0], np.cumsum(np.where(n > 0, n, count > 0))])
    out = np.zeros(start[-1], np.uint64)
    window = window_hashes(h, size)
    long = np.repeat(n > 0, np.where(n > 0, n, count > 0))
    place = np.arange(int(n.sum())) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    out[long] = window[place]
    for k in np.flatnonzero((n == 0) & (count > 0)):
        out[start[k]] = mix(window_hashes(h[off[k] : off[k + 1]], int(count[k])) + np.uint64(count[k]))[0]
    return grouped_distinct(out, start)


def fingerprints(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: sums of two mixes of its members."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ salt))])
        out.append(signed(total[off[1:]] - total[off[:-1]]))
    return out[0], out[1]


FIRST = "doc_id long, n long, f1 long, f2 long, tokens array<long>, seen array<long>"


def first_pass(size: int):
    """Size and fingerprint of each row's set; in rows of null n, tokens that different sets of one chunk share and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, known = [], 0, set()

        def row(doc, n, f1, f2, tokens=None, seen=None) -> pa.RecordBatch:
            k = len(n)
            lists = [pa.array([x] if x is not None else [None] * k, pa.list_(pa.int64())) for x in (tokens, seen)]
            return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), *lists], ["doc_id", "n", "f1", "f2", "tokens", "seen"])

        def shared() -> Iterator[pa.RecordBatch]:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, int((times > 1).sum()), 100_000):
                yield row(pa.array([None], pa.int64()), [None], [None], [None], signed(token[times > 1][a : a + 100_000].copy()), times[times > 1][a : a + 100_000])

        for batch in slices(batches, "text"):
            values, off = shingle_sets(texts_of(batch), size)
            f1, f2 = fingerprints(values, off)
            yield row(batch.column("doc_id"), np.diff(off), f1, f2)
            for k, f in enumerate(f1.tolist()):
                if off[k + 1] > off[k] and f not in known:
                    known.add(f)
                    held.append(values[off[k] : off[k + 1]])
                    total += len(held[-1])
            if total >= CHUNK:
                yield from shared()
                held, total, known = [], 0, set()
        if held:
            yield from shared()

    return run


def often_seen(first: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The OFTEN most shared tokens at most: sorted, each with its rank by count and its count."""
    counts = first.where("n is null").select(F.explode(F.arrays_zip("tokens", "seen")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.seen").alias("seen"))
    counts = scratch.table(counts, "often")
    steps = {r.step: r["count"] for r in counts.groupBy(F.least(F.floor(4 * F.log2("seen")), F.lit(160)).alias("step")).count().collect()}
    least, total = 161, 0
    for step in sorted(steps, reverse=True):
        if total + steps[step] > OFTEN:
            break
        least, total = step, total + steps[step]
    got = counts.where(F.least(F.floor(4 * F.log2("seen")), F.lit(160)) >= least).toArrow()
    token, seen = got["token"].to_numpy().astype(np.int64).view(np.uint64), got["seen"].to_numpy().astype(np.int64)
    rank = np.empty(len(seen), np.int64)
    rank[np.lexsort((token, seen))] = np.arange(len(seen))
    order = np.argsort(token)
    return token[order], rank[order], seen[order]


def prefixes(size: int, percent: int, often: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Per set its size n, prefix length p and the prefix: keys that ascend in the global order."""
    token, rank, seen = often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, off = shingle_sets(texts_of(batch), size)
            key, count = (values >> np.uint64(2)).view(np.int64), np.ones(len(values), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, values), len(token) - 1)
                hit = token[at] == values
                key[hit] = (1 << 62) + (rank[at[hit]] << 40) + (key[hit] & ((1 << 40) - 1))
                count[hit] = seen[at[hit]]
            lengths, out = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                n = b - a
                base, alpha = n - -(-percent * n // 100) + 1, -(-2 * percent * n // (100 + percent))
                own = key[a:b]
                near = np.argsort(own) if n <= 32 else np.argpartition(own, min(n - 1, base + EXTENSIONS[-1]))[: base + EXTENSIONS[-1] + 1]
                near = near[np.argsort(own[near])]
                read = np.cumsum(count[a:b][near])
                p = base if n else 0
                if n and read[min(base, n) - 1] > base:  # else no token of it is known to be shared: nothing to gain
                    choices = [min(n, base + e) for e in EXTENSIONS]
                    p = min(choices, key=lambda c: read[c - 1] * (1 + VERIFY_COST / max(1, c - n + alpha)))  # noqa: B023
                lengths.append(p)
                out.append(own[near[:p]])
            keys = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(lengths, pa.int64()), list_array(keys, np.concatenate([[0], np.cumsum(lengths)]), pa.int64())],
                                             ["doc", "n", "p", "keys"])

    return run


def required(n1, p1, n2, p2, percent: int):
    """Prefix tokens that two sets must share to link; 0 where their sizes rule a link out."""
    alpha = -(-percent * (n1 + n2) // (100 + percent))
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return np.where(fits, np.minimum(p1 - n1, p2 - n2) + alpha, 0)


def run_pairs(percent: int):
    """Pairs within ``reach`` places of each other in a run of one (key, salt), if enough matchable tokens follow in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            key, salt, doc, n, p, rest, reach = (t[c].to_numpy() for c in ("key", "salt", "doc", "n", "p", "rest", "reach"))
            xs, ys = [], []
            for d in range(1, int(reach.max(initial=0)) + 1):
                i = np.flatnonzero((key[d:] == key[:-d]) & (salt[d:] == salt[:-d]) & (reach[:-d] >= d))
                if not len(i):
                    break
                j = i + d
                need = required(n[i], p[i], n[j], p[j], percent)
                good = (need > 0) & (rest[i] >= need - 1) & (rest[j] >= need - 1) & (doc[i] != doc[j])
                xs.append(np.minimum(doc[i], doc[j])[good])
                ys.append(np.maximum(doc[i], doc[j])[good])
            pair = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], 1), axis=0) if xs else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], ["x", "y"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if tail is None else pa.concat_tables([tail, t]).combine_chunks()
            if t.num_rows:
                key, salt = t["key"].to_numpy(), t["salt"].to_numpy()
                cut = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1 if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
                tail = t.slice(cut)
                if cut:
                    yield pairs(t.slice(0, cut))
        if tail is not None and tail.num_rows:
            yield pairs(tail)

    return run


def verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, size: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Those ``pairs`` (a written table x < y) whose whole sets link."""
    ids = scratch.table(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), f"{name}-ids")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values, off = shingle_sets(texts_of(batch), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_array(signed(values), off, pa.int64())], ["doc", "set"])

    table = scratch.table(by_ids(docs, ids, "left_semi").mapInArrow(sets, "doc long, set array<long>"), f"{name}-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("sx"), batch.column("sy"), strict=True):
                a, b = np.asarray(a.values), np.asarray(b.values)
                both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                good.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("x", "y")], ["x", "y"])

    left = pairs.join(table.select(F.col("doc").alias("x"), F.col("set").alias("sx")), "x")
    both = left.join(table.select(F.col("doc").alias("y"), F.col("set").alias("sy")), "y").select("x", "y", "sx", "sy")
    return scratch.table(both.mapInArrow(compare, "x long, y long").distinct(), f"{name}-links")


def shared_keys(guest: np.ndarray, code: np.ndarray, held: np.ndarray, first: np.ndarray, guests: int, homes: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that each guest shares with each resident, and how many of them have a code below ``before``; ``held[first[c]:first[c + 1]]`` are the residents with key c."""
    both, early = np.zeros(guests * homes, np.int64), np.zeros(guests * homes, np.int64)
    count = first[code + 1] - first[code]
    part = np.cumsum(count) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(code)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = count[a:b]
        at = np.arange(int(k.sum())) + np.repeat(first[code[a:b]] - (np.cumsum(k) - k), k)
        pair = np.repeat(guest[a:b] * homes, k) + held[at]
        both += np.bincount(pair, minlength=len(both))
        early += np.bincount(pair[np.repeat(code[a:b] < before, k)], minlength=len(both))
    return both.reshape(guests, homes), early.reshape(guests, homes)


def strays_meet(percent: int, best: bool):
    """In one block of a long run: visitors against residents of other components that share enough prefix tokens, at the first token that they share.

    ``best``: a visitor takes, of each other component, only the resident that shares most beyond what is required.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        own = key[0].as_py()
        doc, n, p, comp, stray, visits = (t[c].to_numpy(zero_copy_only=False) for c in ("doc", "n", "p", "component", "stray", "visits"))
        lists = t["keys"].combine_chunks()
        flat, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        names, code = np.unique(flat, return_inverse=True)
        row, place = np.repeat(np.arange(len(doc)), np.diff(off)), np.cumsum(visits) - 1
        guest, home = np.flatnonzero(visits), np.flatnonzero(~visits)
        in_home = ~visits[row]
        order = np.argsort(code[in_home], kind="stable")
        held = (np.arange(len(doc)) - place - 1)[row[in_home][order]]  # residents by key
        first = np.searchsorted(code[in_home][order], np.arange(len(names) + 1))
        row, code = row[~in_home], code[~in_home]  # by guest
        before = np.searchsorted(names, own)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(guest), 256):
            g = guest[at : at + 256]
            need = required(n[g][:, None], p[g][:, None], n[home][None, :], p[home][None, :], percent)
            good = (need > 0) & (comp[g][:, None] != comp[home][None, :]) & (~stray[home][None, :] | (doc[g][:, None] < doc[home][None, :]))
            mine = slice(*np.searchsorted(row, [g[0], g[-1] + 1]))
            both, early = shared_keys(place[row[mine]] - at, code[mine], held, first, len(g), len(home), before)
            good &= (both >= need) & (early == 0)
            i, j = np.nonzero(good)
            if best:
                order = np.lexsort((need[i, j] - both[i, j], comp[home[j]], i))
                i, j = i[order], j[order]
                new = np.append(True, (np.diff(i) != 0) | (np.diff(comp[home[j]]) != 0))[: len(i)]
                i, j = i[new], j[new]
            xs.append(np.minimum(doc[g[i]], doc[home[j]]))
            ys.append(np.maximum(doc[g[i]], doc[home[j]]))
        return pa.table({"x": np.concatenate(xs), "y": np.concatenate(ys)})

    return run


def seated(match: DataFrame, known: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of long runs in (key, block, guests): every block of residents with every block of strays that visit it, so a group is bounded by two blocks."""
    blocks = lambda rows: F.ceil(rows / BLOCK)
    far = match.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sums = far.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("k", "component")).alias("main"), (F.sum("k") - F.max("k")).alias("strays")).where("parts > 1")
    far = far.join(scratch.table(sums, f"{name}-runs"), "key").withColumn("stray", F.col("component") != F.col("main"))
    own = lambda rows: F.pmod(F.xxhash64("doc"), blocks(rows))
    every = lambda rows: F.sequence(F.lit(0).cast("long"), blocks(rows) - 1)
    seats = F.transform(every(F.col("strays")), lambda b: F.struct(own(F.col("df")).alias("block"), b.alias("guests"), F.lit(False).alias("visits")))
    tour = F.transform(every(F.col("df")), lambda b: F.struct(b.alias("block"), own(F.col("strays")).alias("guests"), F.lit(True).alias("visits")))
    return far.withColumn("seat", F.explode(F.when(F.col("stray"), F.concat(seats, tour)).otherwise(seats))).select("key", "seat.block", "seat.guests", "doc", "n", "p", "keys", "component", "stray", "seat.visits")


def long_runs(match: DataFrame, known: DataFrame, percent: int, best: bool, scratch: Scratch, name: str) -> DataFrame:
    """Candidates (x < y) across the components ``known`` (node, component) in runs of ``match``."""
    return seated(match, known, scratch, name).groupBy("key", "block", "guests").applyInArrow(strays_meet(percent, best), "x long, y long").distinct()


def near_groups(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80, run: int = RUN) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text): sets link at a Jaccard similarity of percent / 100 or more."""
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = scratch.table(docs.mapInArrow(first_pass(size), FIRST), "first")
    often = often_seen(first, scratch)
    rows = first.where("n is not null").select("doc_id", "n", "f1", "f2")
    full = rows.where("n > 0 and doc_id is not null")
    # Sums are written before they are joined: Spark splits hot keys only where both sides come straight from a shuffle.
    classes = scratch.table(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc")), "classes")
    members = scratch.table(full.join(classes, ["n", "f1", "f2"]).select("doc_id", "doc"), "members")
    # Rows that share a doc_id are one node even where their texts differ: such a node is in several classes, and links them.
    nodes = scratch.table(members.groupBy("doc_id").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "nodes")
    copies = scratch.table(nodes.where("low < doc_id and high < doc_id").select("doc_id"), "copies")
    several = scratch.table(nodes.where("low < high").select("doc_id"), "several")
    bridges = by_ids(members, several, "left_semi").where("doc_id <> doc").select(F.least("doc_id", "doc").alias("x"), F.greatest("doc_id", "doc").alias("y")).distinct()

    posted = scratch.table(by_ids(docs.where("doc_id is not null"), copies, "left_anti").mapInArrow(prefixes(size, percent, often), "doc long, n long, p long, keys array<long>").where("n > 0"), "prefixes")
    each = posted.select("doc", "n", "p", F.explode("keys").alias("key"))
    shared = scratch.table(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    held = each.join(shared, "key").groupBy("doc", "n", "p").agg(F.array_sort(F.collect_list(F.struct("key", "df"))).alias("held"))
    held = scratch.table(held.select("doc", "n", "p", F.col("held.key").alias("keys"), F.col("held.df").alias("dfs")), "matched")
    scratch.drop("prefixes", "often")
    match = held.select("doc", "n", "p", "keys", F.posexplode(F.arrays_zip("keys", "dfs")).alias("at", "x")).select(
        "doc", "n", "p", "keys", "at", F.col("x.keys").alias("key"), F.col("x.dfs").alias("df"), (F.size("keys") - F.col("at") - 1).cast("long").alias("rest"))

    blocks = F.ceil(F.col("df") / BLOCK)
    near = match.where((F.col("df") <= run) | (F.col("at") < 4)).select(
        "key", F.when(F.col("df") > run, F.pmod(F.xxhash64("key", "doc"), blocks)).otherwise(0).cast("long").alias("salt"), F.xxhash64("doc", "key").alias("order"),
        "doc", "n", "p", "rest", F.when(F.col("df") > run, 2).otherwise(run).cast("long").alias("reach"))
    pairs = near.repartition("key", "salt").sortWithinPartitions("key", "salt", "order").mapInArrow(run_pairs(percent), "x long, y long").distinct()
    links = verified(spark, docs, scratch.table(pairs, "pairs"), size, percent, scratch, "near").unionByName(scratch.table(bridges, "bridges"))

    known = scratch.table(components(links, scratch, "near-stars"), "near-components")
    if not shared.where(F.col("df") > run).isEmpty():
        for name, best in (("best", True), ("far", False)):
            met = scratch.table(long_runs(match.where(F.col("df") > run), known, percent, best, scratch, name), f"{name}-pairs")
            if met.isEmpty():  # then no two components share enough, so the next time round finds nothing either
                break
            more = verified(spark, docs, met, size, percent, scratch, name)
            if not more.isEmpty():
                known = scratch.table(merged(known, more, scratch, f"{name}-stars"), f"{name}-components")
    groups = known.select(F.col("node").alias("doc"), "component")
    of = members.join(groups, "doc", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "doc")).alias("component_id"))
    return rows.join(of, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have a smaller doc_id in their group. Rows that share a doc_id are one document, with all its texts; those that repeat its text too stay once."""
    scratch = Scratch(spark, "one-of-each")
    groups = scratch.table(near_groups(spark, docs, size, percent), "groups")
    gone = scratch.table(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    twice = scratch.table(groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    left = by_ids(docs, gone, "left_anti")
    if twice.isEmpty():
        return left
    return by_ids(left, twice, "left_anti").unionByName(by_ids(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark, read_table(spark, sf_dir, "documents"), 4, 85)


SQL = """with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * o >= 85 * (nx.n + ny.n - o)),
e as (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(n, 0) n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) component_id from d left join n using (doc_id) left join (select x doc_id, min(y) c from r group by x) using (doc_id)"""

QUERIES = {"op5_adaptive_prefix_join": op5_adaptive_prefix_join}
ORACLES = {"op5_adaptive_prefix_join": SQL}
