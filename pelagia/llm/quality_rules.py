"""Operator 7, quality rules with risk-controlled thresholds.

Rules compare signals of a text with cutoffs. A fixed path of joint cutoffs leads from mild to
strict; at each step all rules together reject some of a stratum's labelled good documents (the
holdout), and that number is tested against the exact binomial distribution: a step holds if so
few rejections have a probability of at most delta were the true rate of false rejection at
``max_false`` or above. Steps are tested in order until one fails, which needs no correction
within a stratum; delta is shared by the strata (Bonferroni). So with probability 1 - delta no
stratum loses more than ``max_false`` of its good documents to the rules. A stratum with too few labels
(fewer than log(delta / strata) / log(1 - max_false)) holds no step and rejects nothing.

Null texts have no words and fail the base rules; null and empty strata are one stratum; documents that
have both labels count as bad; copies of a text (told by 64 bits) are one document of the holdout, as they are rejected together; repeated rows are judged each; empty tables give no rows, or
no cutoffs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import BROADCAST_IDS, Scratch, mix, read_table, slices, split_words, texts_of, window_hashes, word_hashes

REPEAT = 8
SYMBOLS = b"#*$%&|<>"
SIGNALS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, tag long"


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def repeated_words(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text, words inside windows of REPEAT words that the text holds twice or more."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    window = window_hashes(hashes, REPEAT)
    inside = np.arange(len(window)) + REPEAT <= off[1:][doc[: len(window)]]
    at = np.flatnonzero(inside)
    key = mix(window[at] + mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[twice] += 1
    edge[twice + REPEAT] -= 1  # each start, and so each end, is there once
    return _sums(np.cumsum(edge)[:-1] > 0, off)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    for batch in slices(batches, "text"):
        texts = pa.concat_arrays([texts_of(batch)])
        words, off = split_words(texts)
        raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
        lists = pc.split_pattern(texts, "\n")
        lines, line_off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
        doc = np.repeat(np.arange(batch.num_rows), np.diff(line_off))
        key = (doc[full] << 32) + lines.dictionary_encode().indices.to_numpy()[full]
        n_lines = np.bincount(doc[full], minlength=batch.num_rows)
        distinct = np.bincount(np.unique(key) >> 32, minlength=batch.num_rows)
        columns = [batch.column("doc_id"), batch.column("stratum"), np.diff(off), _sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), off),
                   _sums(table[raw], ends), n_lines, n_lines - distinct, repeated_words(word_hashes(words), off), batch.column("tag")]
        names = [x.strip().split(" ")[0] for x in SIGNALS.split(",")]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x, np.int64)) for x in columns], names)


#: Rules: a signal (SQL over SIGNALS, null where it says nothing) and the side that is rejected.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols / nullif(cast(n_words as double), 0)", ">"),
    "long_words": ("word_chars / nullif(cast(n_words as double), 0)", ">"),
    "short_words": ("word_chars / nullif(cast(n_words as double), 0)", "<"),
    "same_lines": ("n_dup_lines / nullif(cast(n_lines as double), 0)", ">"),
    "same_words": ("n_repeat_words / nullif(cast(n_words as double), 0)", ">"),
    "few_words": ("cast(n_words as double)", "<"),
}
#: The path: cutoffs in force at each step, each at least as strict as the one before.
PATH: list[dict[str, float]] = [
    {"symbols": 2},
    {"symbols": 1, "long_words": 20, "short_words": 1.5},
    {"symbols": 0.5, "long_words": 15, "short_words": 2, "same_lines": 0.8},
    {"symbols": 0.3, "long_words": 12, "short_words": 2.5, "same_lines": 0.6},
    {"symbols": 0.2, "long_words": 10, "short_words": 3, "same_lines": 0.5, "same_words": 0.28},
    {"symbols": 0.1, "long_words": 9, "short_words": 3.25, "same_lines": 0.4, "same_words": 0.25, "few_words": 22},
    {"symbols": 0.05, "long_words": 8.5, "short_words": 3.5, "same_lines": 0.3, "same_words": 0.2, "few_words": 25},
    {"symbols": 0.02, "long_words": 8, "short_words": 3.75, "same_lines": 0.2, "same_words": 0.15, "few_words": 30},
]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for success rate p."""
    return min(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(k + 1)))


def choose(rejected: list[int], n: int, limit: float, delta: float) -> int:
    """How many steps of the path hold, given how many of n good documents each rejects."""
    for step, k in enumerate(rejected):
        if n == 0 or k / n >= limit or binomial_tail(k, n, limit) > delta:
            return step
    return len(rejected)


def step_of(rule: str) -> Column:
    """The first step at which a rule rejects a row; as many as there are if none does."""
    signal, side = RULES[rule]
    value, out = F.expr(signal), F.lit(len(PATH))
    for k in reversed(range(len(PATH))):
        if rule in PATH[k]:
            out = F.when(value < PATH[k][rule] if side == "<" else value > PATH[k][rule], k).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def thresholds(signals: DataFrame, labels: DataFrame, max_false: float, delta: float) -> DataFrame:
    """(own, held): how many steps of the path hold in each stratum that has labels, by counts over its good documents."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    tested = signals.where(~base_failed()).join(good, "doc_id", "left_semi").withColumn("own", F.coalesce("stratum", F.lit(""))).dropDuplicates(["own", "tag"])
    counts = tested.groupBy("own", F.least(*(step_of(r) for r in RULES)).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    strata = tested.agg(F.count_distinct("own").alias("strata"))  # one row

    def test(group: pa.Table) -> pa.Table:
        by = dict(zip(group["step"].to_pylist(), group["n"].to_pylist(), strict=True))
        rejected = np.cumsum([by.get(k, 0) for k in range(len(PATH))]).tolist()
        held = choose(rejected, sum(by.values()), max_false, delta / group["strata"][0].as_py())
        return pa.table({"own": group["own"][:1], "held": pa.array([held], pa.int32())})

    return counts.join(F.broadcast(strata)).groupBy("own").applyInArrow(test, "own string, held int")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Signals of each row, base_failed, kept and the rules against it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text", F.xxhash64("text").alias("tag"))
    scratch = Scratch(spark, "quality")
    signals = scratch.table(rows.mapInArrow(measure, SIGNALS), "signals")
    limits = scratch.table(thresholds(signals, labels, max_false, delta), "limits")
    held = F.coalesce("held", F.lit(0))
    against = F.array_compact(F.array(*(F.when(step_of(r) < held, F.lit(r)) for r in RULES)))
    judged = signals.withColumn("own", F.coalesce("stratum", F.lit(""))).join(F.broadcast(limits) if limits.count() <= BROADCAST_IDS else limits, "own", "left")
    judged = judged.drop("tag")
    return judged.withColumns({"base_failed": base_failed(), "against": against}).withColumn("kept", ~F.col("base_failed") & (F.size("against") == 0)).drop("own", "held")


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("against", ",").alias("against"))


QUERIES = {"op7_risk_controlled_quality": op7_risk_controlled_quality}
ORACLES: dict[str, str] = {}
