"""Operator 11, spelling variants by wildcard groups, without pairs.

Words of the whole corpus are counted, in the tasks that read the texts first, and numbered in code-point order. Two words
are near if they differ by one inserted, deleted or replaced code point. A word with the code point at ``position`` cut out
gives the row (cut, position, word, n), so all words that share a row's (position, prefix, suffix) differ in that place alone: such a group tells each
member how many others it has and the largest other, which is its first or second word. Words join the same rows as cuts
of nothing: where a cut is itself a word, it is near the words it was cut from, once each although several positions may
give the same cut. Nothing is emitted for a pair: each row tells how many near words it stands for, and the best of them.

Rows move twice, by cut and by word; they hold numbers of words, and a hash in place of a long cut, so a word of any length has
rows of bounded size. A (cut, position) has as many words at most as there are letters, a cut as many as letters times places. Forms point to words of at least ``ratio`` times the count, so following them to the last (by
doubling) takes as many rounds as the logarithm of the logarithm of the largest count. Null texts have no words; a null
doc_id counts as the empty string; repeated rows count each; ties go to the smallest word in code-point order; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .periodic_runs import CRC_TABLE, crc_sql
from .textkit import BASE, BROADCAST_IDS, Scratch, mix, read_table, slices, texts_of

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST_SEEN, RATIO, TYPO_EVERY = 5, 3, 2, 97
#: Words that a task holds before it hands their counts on.
HELD = 500_000
#: Cuts of more letters than this are told by 128 bits of hashes.
PLAIN = 64
SALTS = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x632BE59BD9B4E019)


def count_words(docs: DataFrame, typo_every: int = 0, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of all runs of letters, lower-cased in A-Z only. With ``typo_every`` a run loses a letter where that divides the crc32 of doc_id:run; the tables have no typing errors of their own."""
    run = re.compile(RUN)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), pc.ascii_lower(texts_of(batch)).to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(text)).items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), head)
                        if h % typo_every == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1 :]
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) >= HELD:
                yield told()
                held.clear()
        if held:
            yield told()

    each = docs.select("doc_id", "text").mapInArrow(tally, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words (word, id, n) the rows (cut, position, first, id, n): itself at position 0, and each word with one code point cut out; first: no position before gives the same cut."""
    names = ["cut", "position", "first", "id", "n"]

    def rows(cuts: list[str], positions, firsts, ids, ns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cuts, pa.string()), pa.array(positions, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], names)

    for batch in batches:
        cuts, positions, firsts, ids, ns = [], [], [], [], []
        for word, own, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n")), strict=True):
            size = len(word)
            if size <= PLAIN:
                cuts += [word, *(word[:i] + word[i + 1 :] for i in range(size))]
            else:
                code = np.array([ord(c) for c in word], np.uint64)
                names_of = [hashed_cuts(code, salt) for salt in SALTS]
                cuts += [f"{a:016x}{b:016x}" for a, b in zip(*(x.tolist() for x in names_of), strict=True)]
                if size == PLAIN + 1:  # its cuts are short enough to be words of their own
                    cuts[-size:] = [word[:i] + word[i + 1 :] for i in range(size)]
            positions += range(size + 1)
            firsts += [False, True, *(a != b for a, b in zip(word, word[1:], strict=False))]
            ids += [own] * (size + 1)
            ns += [n] * (size + 1)
            if len(cuts) >= 50_000:
                yield rows(cuts, positions, firsts, ids, ns)
                cuts, positions, firsts, ids, ns = [], [], [], [], []
        if cuts:
            yield rows(cuts, positions, firsts, ids, ns)


def hashed_cuts(code: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hash of a word and of the word without each of its code points, from sums of place-weighted codes."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(code), BASE)]))
        value = mix(code ^ salt)
        before = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:-1])])
        after = before[-1] - before[1:]
        less = np.uint64(pow(int(BASE), -1, 2**64))
        return mix(np.concatenate([before[-1:], before[:-1] + after * less]))


def near_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """id, n_near, form (an id) and form_n of each row of ``words`` (word, id, n): distinct words with ids in code-point order. form is the near word of largest n if that is ``ratio`` times the word's n or more."""
    rows = words.select("word", "id", "n").mapInArrow(cut_rows, "cut string, position int, first boolean, id long, n long")
    better = F.struct((-F.col("n")).alias("less"), "id")  # the smallest is the word of largest n, then of smallest code points
    group, cut = Window.partitionBy("cut", "position"), Window.partitionBy("cut")
    ranked = group.orderBy(F.desc("n"), "id")
    rows = rows.repartition("cut").withColumns({
        "others": F.count(F.lit(1)).over(group) - 1, "place": F.row_number().over(ranked), "top": F.first(better).over(ranked), "second": F.lead(better).over(ranked),
        "whole": F.min(F.when(F.col("position") == 0, better)).over(cut), "longer": F.count(F.when(F.col("first"), 1)).over(cut), "long_top": F.min(F.when(F.col("position") > 0, better)).over(cut)})
    replaced = F.when(F.col("others") > 0, F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("top")))
    cut_word = F.col("first") & F.col("whole").isNotNull()
    told = rows.select("id", F.when(F.col("position") == 0, F.col("n")).alias("n"),
                       F.when(F.col("position") == 0, F.col("longer")).otherwise(F.col("others") + cut_word.cast("long")).alias("near"),
                       F.when(F.col("position") == 0, F.col("long_top")).otherwise(F.least(replaced, F.when(cut_word, F.col("whole")))).alias("best"))
    found = told.where("near > 0 or n is not null").groupBy("id").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    form_n = -F.col("best.less")
    is_form = form_n >= ratio * F.col("n")
    return found.select("id", "n_near", F.when(is_form, F.col("best.id")).alias("form"), F.when(is_form, form_n).alias("form_n"))


def followed(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of each row of ``forms`` (id, form): the last word that forms lead to. Each round doubles the steps taken."""
    now, k = scratch.table(forms.select("id", F.col("form").alias("root")), "roots-0"), 0
    small = now.count() <= BROADCAST_IDS
    while True:
        k += 1
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = scratch.table(now.join(F.broadcast(ahead) if small else ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        if now.where("moved").isEmpty():
            return now.select("id", "root")
        now = now.select("id", "root")


def spelling_variants(spark: SparkSession, docs: DataFrame, least_seen: int = LEAST_SEEN, ratio: int = RATIO, typo_every: int = 0) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of ``docs`` (doc_id, text) of five letters or more that occur ``least_seen`` times or more."""
    scratch = Scratch(spark, "spelling")
    counted = scratch.table(count_words(docs, typo_every).where(F.col("n") >= least_seen), "counted")
    # Ids that ascend over the sorted ranges of words ascend over all words.
    words = scratch.table(counted.repartitionByRange("word").sortWithinPartitions("word").select("word", F.monotonically_increasing_id().alias("id"), "n"), "words")
    near = scratch.table(near_words(words, ratio), "near")
    roots = followed(near.where("form is not null"), scratch)
    told = words.join(near, "id").join(roots, "id", "left")
    name = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    return told.join(name("form"), "form", "left").join(name("root"), "root", "left").select(
        "word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))


def op11_wildcard_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark, read_table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY).select("word", "form", "root", "n", "n_near", "form_n")


_BYTES = "flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || w, ''), lambda x: case when unicode(x) < 128 then [cast(unicode(x) as bigint)] else [195, unicode(x) - 64] end))"

SQL = f"""with recursive crc as {CRC_TABLE},
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) w from documents),
d as (select doc_id, w, count(*) c from r group by all),
h as (select w, c, {crc_sql(_BYTES, "t")} h from d, crc),
v as (select case when h % {TYPO_EVERY} = 0 then w[:h % length(w)] || w[h % length(w) + 2:] else w end word, cast(sum(c) as bigint) n from h group by 1 having length(word) >= {SHORTEST} and n >= {LEAST_SEEN}),
c as (select word, n, i, word[:i - 1] || word[i + 1:] cut from (select word, n, unnest(range(1, length(word) + 1)) i from v)),
p as (select a.word, b.word other, b.n from c a join c b on a.cut = b.cut and a.i = b.i and a.word <> b.word
      union select c.word, v.word, v.n from c join v on v.word = c.cut union select v.word, c.word, c.n from c join v on v.word = c.cut),
b as (select word, count(*) n_near, first(other order by n desc, other) best, max(n) best_n from p group by word),
f as (select v.word, v.n, coalesce(n_near, 0) n_near, case when best_n >= {RATIO} * v.n then best end form, case when best_n >= {RATIO} * v.n then best_n end form_n from v left join b using (word)),
s as (select word, word here, 0 k from f union all select s.word, f.form, k + 1 from s join f on f.word = s.here where f.form is not null),
t as (select word, arg_max(here, k) root from s group by word)
select word, form, root, n, n_near, form_n from f join t using (word)"""

QUERIES = {"op11_wildcard_spelling": op11_wildcard_spelling}
ORACLES = {"op11_wildcard_spelling": SQL}
