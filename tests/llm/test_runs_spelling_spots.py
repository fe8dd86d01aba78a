"""Operators 11 to 13 against brute force, on texts with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pelagia.llm import periodic_runs, spelling_variants, spot_signatures
from pyspark.sql import functions as F


def plain_runs(w: list, least: int) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i = max(i, s + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


@pytest.mark.parametrize("least", [5, 12])
def test_runs_of_many_texts(least):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.choice([0, 1, 5, 30, 60, 120]), rng.choice([1, 2, 2, 3, 8])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w * rng.choice([1, 1, 1, 3]))
        off = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        want = [(a + o, b + o, q) for o, w in zip(off, texts, strict=False) for a, b, q in plain_runs(w, least)]
        got = periodic_runs.runs_of(np.array([c for w in texts for c in w], np.int64), off, least)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_fewest_words_of_a_run():
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), np.array([0, 9]), 4)


def test_periodic_runs_of_documents(documents, corpus, nothing):
    want = []
    for doc, text, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(w, 12) if len(w) < 1500 else None
        want.append((doc, len(w), runs, w))
    got = sorted(((r.doc_id, r.n_words, [(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(documents).collect()), key=str)
    plain = []
    for doc, n, runs, w in want:
        if runs is None:
            runs = next(r for d, m, r, _ in got if d == doc and m == n)
            assert doc == 8 and not runs  # 6,000 random words
        gone = {i for a, b, q in runs for i in range(a + q, b)}
        plain.append((doc, n, sorted(runs, key=lambda r: (r[0], r[2])), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(plain, key=str)
    assert periodic_runs.periodic_runs(nothing).count() == 0


def test_planted_runs(spark):
    rng = random.Random(7)
    rows = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 9, 40])))) for d in range(300)] + [(None, "a b c"), (1, None), (2, "")]
    got = {(r.doc_id, r.text) for r in periodic_runs.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = set()
    for doc, text in rows:
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        w = (text or "").split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        want.add((doc, text))
    assert got == want and len(got) == len(rows)


def plain_variants(rows: list[tuple], typo_every: int, least_seen: int) -> set[tuple]:
    n: dict[str, int] = {}
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least_seen}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n.get(form[w])))
    return out


def variant_rows() -> list[tuple]:
    rng = random.Random(3)
    long = "ab" * 32
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "aaaba", "Straßen", "straßen", "ÀÀÀÀÀ", "ÀÀÀÀé", "éÀÀÀÀ", "colour", "color", "colours", "coloürs", long, long + "a", long + "ab", long + "aa", "b" + long + "ab", "x" * 3000, "x" * 3001, "x" * 2999 + "y"]
    rows = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["", ".", "-end 12"])) for d in range(90)]
    tree = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(60)]
    return rows + [(200 + k, " ".join(t for t in tree for _ in range(rng.randint(0, 3)))) for k in range(4)] + [(None, "colour COLOR"), (5, None), (6, ""), (7, "colour"), (7, "colour")]


@pytest.mark.parametrize("typo_every", [0, 5])
def test_spelling_variants(spark, typo_every):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "id", "cut", "root")}).repartition(3)
    got = spelling_variants.spelling_variants(spark, docs, typo_every=typo_every)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain_variants(rows, typo_every, 3)
    assert got.count() == got.select("word").distinct().count()


def test_no_words(spark, nothing, documents):
    assert spelling_variants.spelling_variants(spark, nothing).count() == 0
    assert spelling_variants.spelling_variants(spark, documents.where("text is null")).count() == 0


def plain_signatures(text: str) -> list[int]:
    low = text.lower()
    w = re.findall(r"[^\W_]+", low) or re.findall(r"\S+", low)
    anchors = set(spot_signatures.ANCHORS)
    out = set()
    for i, a in enumerate(w):
        rest = [x for x in w[i + 1 :] if x not in anchors]
        if a in anchors and len(rest) >= 2:
            out.add(zlib.crc32(" ".join([a, *rest[:2]]).encode()))
    if not out:
        out = {zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(len(w))}
    return sorted(out)


def like(a: list[int], b: list[int]) -> float:
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def spot_rows() -> list[tuple]:
    rng = random.Random(11)
    pool = ["the", "of", "and", "Le", "der", "house", "Garten", "été", "wide", "river", "no-one", "12"]
    rows = [(d, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 20, 80])))) for d in range(40)]
    return rows + [(None, "The last of all houses here"), (41, None), (42, ""), (43, "### !!"), (44, "the of and"), (45, "\U0001f600 the \U0001f600 wide house \U0001f600"), (46, "word"), (7, rows[7][1]), (7, "the other text of this id"), (60, rows[3][1])]


@pytest.mark.parametrize("rows", [spot_rows(), [(5, "the only wide house")], [(5, "the wide house"), (5, "the wide house")], [(k, "the same text of all here") for k in range(9)]])
def test_fingerprints_and_edited_texts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "found", "part", "next", "range")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = spot_signatures.op13_spot_signatures(spark, str(tmp_path)).collect()
    order = sorted({(d is None, 0 if d is None else -d, f"{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}", t or "") for d, t in rows})
    after = {a[2]: b[3] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    want = []
    for d, t in rows:
        t = t or ""
        other = after[f"{'' if d is None else d}:{hashlib.md5(t.encode()).hexdigest()}"]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        own, new = plain_signatures(t), plain_signatures(edited)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in own), "".join(f"{x:08x}" for x in new), like(own, new), like(own, plain_signatures(other))))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)


def test_fingerprints_of_no_documents(spark, tmp_path, nothing):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert spot_signatures.op13_spot_signatures(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_near_pairs(spark, percent):
    rng = random.Random(percent)
    base = [sorted(rng.sample(range(300), rng.choice([1, 4, 10, 40]))) for _ in range(12)]
    sets = [(k, sorted(set(base[k % 12]) - {rng.choice(base[k % 12])} | ({rng.randrange(300)} if k % 3 else set()))) for k in range(120)] + [(500, []), (501, [1]), (502, [1])]
    df = spark.createDataFrame(sets, "id long, found array<bigint>")
    asked = df.where("id % 7 < 3").withColumnRenamed("id", "query")
    got = {(r["query"], r.id, round(r.likeness, 9)) for r in spot_signatures.near_pairs(asked, df, percent).collect()}
    want = {(q, i, round(like(a, b), 9)) for q, a in sets if q % 7 < 3 for i, b in sets if a and b and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))}
    assert got == want
