"""Operator 6, language identification: sparse multinomial logistic regression on TF-IDF of
character n-grams, trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net
penalties, then temperature calibration.

Features are hashed 1- to ``ORDER``-grams of lower-cased letters (all else counts as a blank);
the weight of a feature is its share of the text's n-grams times its inverse document
frequency, counted over all training rows. The classifier is fitted on at most ``per_lang``
training rows of each language, and calibrated on as many others; both are drawn by a hash
of doc_id. Every whole text is then scored.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
row is labelled. Repeated rows are scored each; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import read_table, slices, texts_of

ORDER = 3
BITS = 15
SIZE = 1 << BITS
#: Weights of a text sum to its mean idf; this brings them to a scale that FTRL's steps fit.
SCALE = 30.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, the hashed n-gram that starts at each letter or blank; per text, where it starts. Texts end in blanks, so no n-gram spans two."""
    blank = " " * ORDER
    joined = pc.binary_join_element_wise(pc.utf8_lower(texts), blank, "")
    size = pc.utf8_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(joined.to_pylist()).encode("utf-32-le"), np.uint32)
    code = np.where(_letters()[code], code, np.uint32(32))
    out, h = [], np.zeros(len(code), np.uint32)
    for k in range(ORDER):
        n = len(code) - k
        h = (h[:n] + code[k:]) * np.uint32(0x9E3779B1)
        out.append(np.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(k)) >> np.uint32(32 - BITS), np.zeros(k, np.uint32)))
    return out, np.concatenate([[0], np.cumsum(size)])


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False).astype(bool)


def counts_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and their counts, text by text."""
    orders, off = grams(texts)
    for a, b in zip(off[:-1], off[1:], strict=True):
        count = np.bincount(np.concatenate([h[a:b] for h in orders]), minlength=SIZE)
        at = np.flatnonzero(count)
        yield at, count[at]


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows (text): texts that hold each feature, and the number of texts. What comes to the driver is as long as the feature space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(SIZE + 1, np.int64), 0
        for batch in slices(batches, "text", 1 << 20):
            for at, _ in counts_of(texts_of(batch)):
                df[at] += 1
                n += 1
        df[SIZE] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["feature", "n"])

    df = np.zeros(SIZE + 1, np.int64)
    for r in rows.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r.feature] = r.n
    return df[:SIZE], int(df[SIZE])


def drawn(rows: DataFrame, per_lang: int, counts: dict[str, int]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About ``per_lang`` rows (doc_id, text, lang) of each language, as sparse counts, in the order of a hash."""
    part = F.lit(1.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, min(1.0, per_lang / max(n, 1))).otherwise(part)
    order = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 24))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = list(counts_of(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("at"), batch.column("doc_id"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
                                             ["lang", "at", "doc_id", "features", "counts"])

    got = rows.withColumn("at", order).where(F.col("at") < part * (1 << 24)).select("lang", "at", "doc_id", "text").mapInArrow(featurise, "lang string, at long, doc_id long, features array<int>, counts array<int>").toArrow()
    got = got.sort_by([("at", "ascending"), ("doc_id", "ascending")])
    return [(lang.as_py(), np.asarray(f.values), np.asarray(c.values)) for lang, f, c in zip(got["lang"], got["features"], got["counts"], strict=True)]


class Ftrl:
    """Multinomial logistic regression, one coordinate-wise FTRL-proximal learner a weight."""

    def __init__(self, size: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one number that, dividing the logits, makes held-out labels most likely (golden section over its logarithm).

    One label in n + 2 counts as wrong (Platt's smoothing), so that no finite sample makes the model certain.
    """
    if not len(labels):
        return 1.0
    wrong = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        p = np.log(softmax(logits / np.exp(t)) + 1e-300)
        return -float(((1 - wrong) * p[np.arange(len(labels)), labels] + wrong * p.mean(1)).mean())

    lo, hi, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(spark: SparkSession, labelled: DataFrame, held_back: DataFrame, per_lang: int = 600, epochs: int = 3) -> dict | None:
    """Model from rows (doc_id, text, lang): ``labelled`` teach it, ``held_back`` set its temperature."""
    counts = [{r.lang: r["count"] for r in rows.groupBy("lang").count().collect()} for rows in (labelled, held_back)]
    langs = sorted(counts[0] or counts[1])
    if not langs:
        return None
    df, n = document_frequency(labelled.select("text").unionByName(held_back.select("text")))
    idf = np.log((1 + n) / (1 + df)) + 1
    learner, number = Ftrl(SIZE + 1, len(langs)), {x: k for k, x in enumerate(langs)}

    def vector(at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(at, SIZE), np.append(SCALE * idf[at] * count / max(1, count.sum()), 1.0)

    sample = drawn(labelled if counts[0] else held_back, per_lang, counts[0] or counts[1])
    for _ in range(epochs):
        for lang, at, count in sample:
            learner.learn(*vector(at, count), number[lang])
    w = learner.weights()
    rest = [x for x in drawn(held_back, per_lang, counts[1]) if x[0] in number]
    logits = np.array([(lambda at, x: x @ w[at])(*vector(at, count)) for _, at, count in rest]).reshape(len(rest), len(langs))
    t = temperature(logits, np.array([number[x[0]] for x in rest], int))
    return {"langs": langs, "weights": (SCALE * idf[:, None] * w[:SIZE] / t).T.astype(np.float32).copy(), "bias": w[SIZE] / t, "temperature": t}


def predict(docs: DataFrame, model: dict | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of each row of ``docs`` (text)."""
    fields = [docs.schema[c] for c in keep]
    column = "text" if "text" in keep else "__text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 1 << 20):
            texts = texts_of(batch, column)
            known = has_letter(texts) if model else np.zeros(batch.num_rows, bool)
            lang, p = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if known.any():
                orders, off = grams(texts)
                logits = np.stack([sum(np.add.reduceat(w[h], off[:-1], dtype=np.float64) for h in orders) for w in model["weights"]], 1)
                prob = softmax(logits / (ORDER * np.diff(off))[:, None] + model["bias"])
                best = prob.argmax(1)
                lang[known] = np.array(model["langs"], object)[best[known]]
                p[known] = prob[np.arange(len(best)), best][known]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(p)], [*keep, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*keep, *([F.col("text").alias(column)] if column not in keep else [])).mapInArrow(score, schema)


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))


def language_model(spark: SparkSession, docs: DataFrame) -> dict | None:
    """Folds 0 and 2 of crc32(doc_id) are the training rows: 0 teaches, 2 calibrates; fold 1 stays unseen."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    return train(spark, rows.where(fold() == 0), rows.where(fold() == 2))


def reject(spark: SparkSession, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without texts of no language, and those whose language is less likely than ``least``."""
    names = docs.columns
    own = [c if c == "text" else f"__c{k}" for k, c in enumerate(names)]  # no column of docs can clash with ours
    got = predict(docs.toDF(*own), language_model(spark, docs), tuple(own))
    return got.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*own).toDF(*names)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    got = predict(docs, language_model(spark, docs))
    return got.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLES: dict[str, str] = {}
