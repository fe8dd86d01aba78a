"""Composites from a stream against those of the batch operator."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pelagia.operators import trailing
from pelagia.streaming import live
from pyspark.sql import functions as F


@pytest.mark.parametrize("minimum", [1, 2])
def test_any_order_gives_the_batch_result(spark, tmp_path, minimum):
    rng = random.Random(minimum)
    first = date(2024, 6, 20)
    rows = [(c, first + timedelta(days=d), rng.choice([None, -1.0, 2.0, 3.5, 8.0]), 1) for c in ("a", "b", "c") for d in range(20) if rng.random() < 0.7]
    rows += [(c, d, rng.choice([None, 5.0, 9.0]), 2) for c, d, _, _ in rng.sample(rows, 10)]  # revised
    rng.shuffle(rows)
    schema = "cell string, day date, value double, version long"
    for k in range(4):  # late days come in later files
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last: dict = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    batches = []

    def keep(df, k):
        batches.append(k)
        for r in df.collect():
            last[r.cell, r.day] = r

    query = live.trailing_composites(stream, 7, minimum).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(240) and len(batches) == 4
    held = spark.createDataFrame(rows, schema).groupBy("cell", "day").agg(F.max_by("value", "version").alias("value"))
    calendar = trailing.spine(held.select("cell").distinct(), trailing.date_spine(spark, str(first), str(first + timedelta(days=30))))
    want = {(r.cell, r.day): r for r in trailing.trailing_composite(held, calendar, "cell", "day", "value", 7, minimum).collect()}
    names = ("trailing_mean", "trailing_log_mean", "trailing_2plus_mean", "valid_days", "newest_age", "oldest_age")
    for key, r in want.items():
        if key in last:
            assert [getattr(last[key], n) if n.endswith(("days", "age")) else getattr(last[key], n) and round(getattr(last[key], n), 12) for n in names] == [getattr(r, n) if n.endswith(("days", "age")) else getattr(r, n) and round(getattr(r, n), 12) for n in names]
        else:
            assert r.valid_days == 0
    assert sum(r.valid_days > 0 for r in want.values()) > 40
