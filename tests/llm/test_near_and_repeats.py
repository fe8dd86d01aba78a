"""Jaccard join and substring removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pelagia.llm import graph, jaccard_join, substring_dedup
from pelagia.llm.graph import components
from pelagia.llm.textkit import Scratch, split_words, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups_of(rows, size, percent):
    sets, parent = [(r[0], shingles(r[1], size)) for r in rows], {r[0]: r[0] for r in rows}  # rows of one id are one node

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(a), find(i)) for i, a in sets)


@pytest.mark.parametrize(("size", "percent", "run"), [(4, 85, 64), (4, 85, 2), (5, 80, 4)])
def test_groups(spark, documents, corpus, size, percent, run):
    got = sorted(map(tuple, jaccard_join.near_groups(spark, documents, size, percent, run).collect()))
    assert got == groups_of(corpus, size, percent)


def test_hot_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(80)] = f"e{d}_{rng.random()}"
        rows.append((d, " ".join(w)))
    got = sorted(map(tuple, jaccard_join.near_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 4).collect()))
    assert got == groups_of(rows, 4, 85)


def test_no_ids_and_no_rows(spark, nothing):
    assert jaccard_join.near_groups(spark, nothing).count() == 0
    got = jaccard_join.near_groups(spark, spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (3, 3)}


def test_one_of_each(spark, documents, corpus):
    left = [tuple(r)[:5] for r in jaccard_join.one_of_each(spark, documents, 5, 80).collect()]
    want = {i for i, n, c in groups_of(corpus, 5, 80) if i == c}
    assert sorted(r[0] for r in left) == sorted(want)


def test_one_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (7, a), (7, b + " tail"), (8, c), (9, c), (9, "quite another text of six"), (3, "lone words of another kind here"), (3, "lone words of another kind here"), (3, c + " and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_groups(spark, docs, 4, 85).collect()))
    assert got == groups_of(rows, 4, 85)
    left = sorted(map(tuple, jaccard_join.one_of_each(spark, docs, 4, 85).collect()))
    assert left == sorted({r for r in rows if dict((i, k) for i, _, k in groups_of(rows, 4, 85))[r[0]] == r[0]})


@pytest.mark.parametrize("many", [1 << 20, 0])
def test_components_of_a_long_path(spark, monkeypatch, many):
    monkeypatch.setattr(graph, "MANY", many)
    n = 40
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (101, 100)], "x long, y long")
    got = {r.node: r.component for r in components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100}


def test_stars_are_known_without_a_round(spark):
    scratch = Scratch(spark, "t")
    got = components(spark.createDataFrame([(k, k % 3) for k in range(30)], "x long, y long"), scratch, "c").collect()
    assert {r.node: r.component for r in got} == {k: k % 3 for k in range(30)} and len(got) == 30
    assert scratch.tables == 1


@pytest.mark.parametrize("few, many", [(1 << 18, 1 << 20), (0, 1 << 20), (1 << 18, 0)])
def test_merged_components_follow_the_new_links_only(spark, monkeypatch, few, many):
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "MANY", many)
    rng = random.Random(few + many)
    old = [(k, k + 1) for k in range(20)] + [(rng.randrange(30, 90), rng.randrange(30, 90)) for _ in range(40)]
    new = [(5, 95), (96, 95), (3, 4), *((rng.randrange(100), rng.randrange(100)) for _ in range(12))]
    parent = list(range(100))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, y in old + new:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    want = {k: root(k) for link in old + new for k in link if link[0] != link[1]}
    scratch, columns = Scratch(spark, "t"), "x long, y long"
    known = scratch.table(components(spark.createDataFrame(old, columns), scratch, "old"), "known")
    got = graph.merged(known, spark.createDataFrame(new, columns), scratch, "new").collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert spark.read.parquet(f"{scratch.root}/new-found").count() <= 2 * len(new)


def removed(rows, window=20):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    for k in order:
        d, w = rows[k][0], WORD.findall(rows[k][1] or "")
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s:s + window]), (d, s))
    for k in order:
        d, w = rows[k][0], WORD.findall(rows[k][1] or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] < (d, s):
                gone[s:s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_repeats(spark, documents, corpus):
    got = substring_dedup.remove_repeats(spark, documents).collect()
    assert sorted(map(tuple, got)) == removed(corpus)
    full = substring_dedup.remove_repeats(spark, documents, texts=True).collect()
    assert sorted(tuple(r)[:4] for r in full) == removed(corpus)
    assert all(hashlib.sha256((r.kept or "").encode()).hexdigest() == r.kept_sha256 for r in full)


def test_repeats_of_few_words(spark):
    """Few different words: long runs, periods, windows without an interior name."""
    rng = random.Random(8)
    rows = [(d, " ".join(rng.choice("ab") if rng.random() < 0.2 else "a" for _ in range(rng.randint(0, 150)))) for d in range(40)]
    rows += [(d, " ".join(["a b c", "a b", "a"][d % 3] for _ in range(40))) for d in range(40, 52)]
    got = substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == removed(rows)


def test_passages_with_other_words_around_them(spark):
    """One passage between many neighbours, shifted, cut short, twice in a text, and under one id with two texts."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(70)]
    rows = []
    for d in range(60):
        a, b = sorted((rng.randrange(70), rng.randrange(71)))
        around = [f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 30))]
        rows.append((d, " ".join([*around, *passage[a:b], *around[::-1], *(passage[b:] if d % 7 == 0 else passage[a:b] if d % 5 == 0 else [])])))
    got = substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == removed(rows)
    two = [(1, " ".join(passage)), (4, "x y z " + " ".join(passage[:40])), (4, " ".join(f"q{k}" for k in range(50)))]
    got = substring_dedup.remove_repeats(spark, spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 70, 0), (4, 43, 40), (4, 50, 0)]


def test_copy_under_an_id_with_another_text(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (7, f"x {b}"), (7, f"x {b}"), (9, b), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(1, 30, 0), (5, 30, 0), (5, 30, 30), (7, 31, 30), (7, 31, 30), (9, 1, 0), (9, 30, 30)]
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark, docs).collect()) == want
    full = substring_dedup.remove_repeats(spark, docs, texts=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in full) == want
    assert sorted((r.doc_id, r.kept) for r in full) == sorted([(1, a), (5, ""), (5, b), (7, "x"), (7, "x"), (9, ""), (9, "short")])


def test_no_rows_to_cut(spark, nothing):
    assert substring_dedup.remove_repeats(spark, nothing).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("aaab"), min_size=20, max_size=60), st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_equal_windows_have_equal_anchors(passage, left, right):
    texts = [" ".join(passage), " ".join([*left, *passage, *right]), " ".join([*right, *passage, *left])]
    words, off = split_words(pa.array(texts))
    start, anchor, place = substring_dedup.anchors(word_hashes(words), off)
    names = words.to_pylist()
    by = {}
    for s, a in zip(start.tolist(), anchor.tolist()):
        assert by.setdefault(tuple(names[s:s + 20]), a) == a
    assert len(start) == int(np.maximum(0, np.diff(off) - 19).sum()) == len(place)


def test_groups_of_long_runs_are_bounded(spark, monkeypatch):
    """A run of strays only: every Spark group holds about two blocks, and all pairs that share enough still meet."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    rng = random.Random(3)
    sets = {d: sorted({7, *rng.sample(range(20), 9)}) for d in range(300)}
    rows = [(d, 10, 6, keys, at, key, 300, len(keys) - at - 1) for d, keys in sets.items() for at, key in enumerate(keys) if key == 7]
    match = spark.createDataFrame(rows, "doc long, n long, p long, keys array<long>, at int, key long, df long, rest long")
    known = spark.createDataFrame([(d, d // 3 * 3) for d in range(300)], "node long, component long")
    scratch = Scratch(spark, "bounded")
    sizes = [r["count"] for r in jaccard_join.seated(match, known, scratch, "sizes").groupBy("key", "block", "guests").count().collect()]
    assert max(sizes) <= 4 * 32 and len(sizes) == 100
    want = set()
    for x in sets:
        for y in range(x + 1, 300):
            both = set(sets[x]) & set(sets[y])
            if x // 3 != y // 3 and len(both) >= jaccard_join.required(np.array(10), np.array(6), np.array(10), np.array(6), 85) and min(both) == 7:
                want.add((x, y))
    got = sorted(map(tuple, jaccard_join.long_runs(match, known, 85, False, scratch, "pairs").collect()))
    assert want and got == sorted(want)
