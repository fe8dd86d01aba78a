"""Packing and token files against the tokenizer itself."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pelagia.llm import textkit
from pelagia.llm.packing import pack_documents, pack_sizes
from pelagia.llm.textkit import Scratch, encoder, tokenizer_path
from pelagia.llm.token_file import WaveletMatrix, load, read_documents, token_shards
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, piece string"
TEXTS = ["", None, "Hello, world's end...", "l'été ́x İ Σας <|endoftext|> a\x1cb　c", "word " * 9000, "same row", "same row", "3.14 ## ..!\n\n don't we'll"]
ROWS = [(i if i != 6 else 5, t, "clash") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
@example(["A\U00013460", "é\U00001c89z", "A\U000105c0, b"])
def test_encoder_equals_tokenizer(texts):
    ids, off = encoder(tokenizer_path())(pa.array(texts, pa.string()))
    tok = Tokenizer.from_file(tokenizer_path())
    for k, t in enumerate(texts):
        assert ids[off[k]:off[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_letters_with_symbols_after_them(tok):
    """All letters below U+20000, some of which turn into letters and marks before they are cut."""
    texts = [a + b + "x" for a in map(chr, range(0x20000)) if a.isalpha() for b in ",'"]
    odd = pc.match_substring_regex(pa.array(texts), textkit._odd()).to_pylist()
    for flag in (False, True):  # one odd text in a batch leaves all of it whole
        part = [t for t, o in zip(texts, odd) if o == flag]
        ids, off = encoder(tokenizer_path())(pa.array(part))
        ids = ids.tolist()
        assert [ids[a:b] for a, b in zip(off[:-1], off[1:])] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
    assert "İ,x" in [t for t, o in zip(texts, odd) if o]


def test_latin_words_of_either_case(tok):
    """Words of letters below U+0250 and of those that turn into such when they are lower-cased, at each place of a word."""
    odd = [c for c in map(chr, range(0x20000)) if c.isalpha() and (c < "\u0250" or max(c.lower()) < "\u0250")]
    words = [w for c in odd for w in (c, f"b{c}", f"{c}b", f"É{c}o", c * 3)]
    got = textkit.WordEncoder(tokenizer_path()).ids_of(words)
    assert got == [e.ids for e in tok.encode_batch(words, add_special_tokens=False)]


def test_a_full_cache_keeps_the_latest_pieces():
    """Once the cache is full, pieces of the last texts are not encoded again; nor do long pieces fill the memory."""
    enc, encoded = textkit.WordEncoder(tokenizer_path(), keep=100), []
    whole = enc.ids_of
    enc.ids_of = lambda new: (encoded.append(len(new)), whole(new))[1]
    first, second = ([" ".join(f"{a}{b}{c}" for b in "bcdf" for c in "klmnoprstuvwxyz")] for a in "ae")
    want = [enc(pa.array(x)) for x in (first, second)]
    assert encoded == [60, 60]
    got = enc(pa.array(second))
    assert encoded == [60, 60] and all((a == b).all() for a, b in zip(got, want[1]))
    assert (enc(pa.array(first))[0] == want[0][0]).all() and encoded == [60, 60, 60]
    enc(pa.array(["x" * 4000]))
    assert len(enc.known) <= 1 and enc.held <= 32 * enc.keep


def test_pieces_and_places(spark, tok):
    for shard_rows in (50_000, 2):
        got = pack_documents(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(3), tokenizer_path(), shard_rows=shard_rows).collect()
        want = []
        for d, t, _ in ROWS:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            want += [(d, k, s, len(ids[s:s + 4096]), crc(ids[s:s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
        assert sorted(tuple(r)[:5] for r in got) == sorted(want)
        spans = defaultdict(list)
        for r in got:
            spans[r.sequence_id].append((r.offset, r.offset + r.length))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and s[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack_documents(spark, none, tokenizer_path()).count() == 0
    assert read_documents(Scratch(spark, "t").table(token_shards(none, tokenizer_path()), "s")).count() == 0


def test_few_sequences():
    sizes = np.random.default_rng(3).integers(1, 4096, 6000) // np.random.default_rng(4).integers(1, 6, 6000) + 1
    at, _, _ = pack_sizes(sizes)
    assert len(set(at.tolist())) <= 1.01 * -(-int(sizes.sum()) // 4096)


def brute_step(counts, size, capacity):
    best = None
    for gap in [*[g for g in range(size, capacity) if counts[g]], capacity]:
        after = counts.copy()
        if gap < capacity:
            after[gap] -= 1
        if gap > size:
            after[gap - size] += 1
        key = (int((after[1:capacity] ** 2).sum()), gap)
        best = min(best, key) if best else key
    return best[1]


def test_rule_is_sum_of_squares():
    from pelagia.llm.packing import SumOfSquares

    packer, counts = SumOfSquares(30), np.zeros(31, np.int64)
    for size in np.random.default_rng(0).integers(1, 31, 400).tolist():
        gap = brute_step(counts, size, 30)
        _, offset = packer.place(size)
        assert 30 - offset == gap
        if gap < 30:
            counts[gap] -= 1
        if gap > size:
            counts[gap - size] += 1


def test_files_round_trip(spark, tok):
    docs = spark.createDataFrame([*ROWS, (None, "no id", "x")], SCHEMA).repartition(3)
    shards = Scratch(spark, "t").table(token_shards(docs, tokenizer_path(), shard_tokens=100), "s")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_documents(shards).collect())
    want, at = [], 0
    for d, t, _ in [(None, "no id", ""), *ROWS]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_shards_end_with_the_document_that_fills_them(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(60)], "doc_id long, text string").repartition(2)
    shards = token_shards(docs, tokenizer_path(), shard_tokens=10).select("part", "seq", "n_docs", "n_tokens", "payload").collect()
    last = {r.part: max(s.seq for s in shards if s.part == r.part) for r in shards}
    for r in shards:
        ids, off, _ = load(r.payload)
        assert len(ids) == r.n_docs and off[-1] == r.n_tokens and off[-2] < 10 and (r.n_tokens >= 10 or r.seq == last[r.part])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=1500))
def test_wavelet_answers(values):
    ids = np.array(values, np.uint16)
    m = WaveletMatrix.build(ids, 6)
    from pelagia.llm.token_file import dump

    _, _, read = load(dump([1], np.array([len(ids)]), ids, 6))
    assert read.before.tolist() == m.before.tolist() and read.decode().tolist() == values
    m = read
    for i in {0, len(values) - 1, len(values) // 2}:
        assert m.access(i) == values[i]
        assert m.count(values[i], i) == values[:i].count(values[i])
        assert m.locate(values[i], values[:i].count(values[i])) == i


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        load(b"x" * 64)
