"""From raw documents to packed training sequences: five stages, each one operator of pelagia.llm.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pelagia.llm import jaccard_join, language_id, packing, secret_scan, source_mixing
from pelagia.llm.textkit import Scratch, read_table, tokenizer_path
from pyspark.sql import DataFrame, SparkSession


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language and texts whose language stays unclear."""
    return language_id.reject(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles that link at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(spark, docs, size=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the text; widely copied examples and all rows stay."""
    return secret_scan.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes four fifths of the tokens by the target weights of domain, language and source, each document once at most."""
    taken = source_mixing.mix(spark, docs, source_mixing.WEIGHTS, share_of_supply=0.8, epochs=1, levels={"domain": source_mixing.DOMAIN}, tokenizer=tokenizer_path())
    return taken.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The first stage's trained model can't be told in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
