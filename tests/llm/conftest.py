from __future__ import annotations

import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): null, empty, blank, long, repeated, copied and nearly copied texts, with nulls in each column."""
    rng = random.Random(5)
    base, passage = prose(rng, 120).split(), prose(rng, 60)
    rows = [(0, None, "en", "src0"), (1, "", "en", "src0"), (2, " \t\n ", None, None), (3, "###", "en", "src1"), (4, "One", "en", "src0"), (5, "two words", "en", "src0"), (5, "two words", "en", "src0"), (6, "Two Words", "en", "src0")]
    rows += [(7, "same same " * 400, "en", "src0"), (8, prose(rng, 6000), "en", "src2"), (9, "x" * 50_000, "en", "src3")]
    for k in range(10, 40):  # near copies, from none to many edits
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 20])):
            w[rng.randrange(len(w))] = prose(rng, 1) + "q"
        rows.append((k, " ".join(w), rng.choice(["en", "fr"]), f"src{k % 12}"))
    for k in range(40, 60):
        rows.append((k, f"{prose(rng, 15)}\n{passage}\t{prose(rng, rng.randint(0, 40))}", "fr", f"src{k % 12}"))
    rows += [(60 + k, prose(rng, rng.randint(1, 200)), rng.choice(["en", "fr", None]), "src0") for k in range(40)]
    rows += [(100, base and " ".join(base), "en", "src4"), (101, "# the line\n" * 30 + prose(rng, 30), "en", None)]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("n", "key", "hash", "stratum", "component", "spans", "rank", "tokens", "epoch", "leaf_budget", "domain", "__cut", "budget", "whole", "part")}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
