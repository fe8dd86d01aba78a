"""Daily products from unbounded samples: what the batch operators give, kept up to date (extension of section 2.10)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly(samples: DataFrame, keys: list[str], value: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Tumbling hours with count, mean and range; samples later than ``late`` behind the newest are dropped by the watermark."""
    x = F.col(value)
    rows = samples.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), *keys)
    return rows.agg(F.count(value).alias("samples"), F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("value_range")).select(F.col("w.start").alias("hour"), *keys, "samples", "mean", "value_range")


def daily_partitions(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Bounded micro-batches: ``build`` rewrites the partitions that a batch touches, so a batch that runs twice changes nothing."""
    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


COMPOSITE = "cell string, day date, trailing_mean double, trailing_log_mean double, trailing_2plus_mean double, valid_days long, newest_age int, oldest_age int"


def trailing_composites(daily: DataFrame, window: int = 7, minimum: int = 1, retain: int = 60) -> DataFrame:
    """What ``trailing_composite`` gives, from daily values that come in any order, late or revised (update mode).

    daily: cell (string), day (date), value, version; of a cell's rows of one day that of the largest version holds. Each batch gives all days whose window a changed day is in;
    a later batch's row of a (cell, day) replaces an earlier one's. A cell's state is its last ``retain`` days up to its newest one; what is older than that is not taken any more.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, float | None]] = {}
        if state.exists:
            days, values, versions = state.get
            held = {d: (v, x) for d, x, v in zip(days, values, versions, strict=True)}
        changed: set[int] = set()
        for frame in frames:
            for day, value, version in zip(frame["day"], frame["value"], frame["version"], strict=True):
                d, x = day.toordinal(), None if value is None or math.isnan(value) or value <= 0 else float(value)
                if d not in held or (version, x or 0.0) > (held[d][0], held[d][1] or 0.0):
                    if held.get(d, (0, None))[1] != x or d not in held:
                        changed.add(d)
                    held[d] = (int(version), x)
        newest = max(held)
        held = {d: x for d, x in held.items() if d > newest - retain}
        kept = sorted(held)
        state.update((kept, [held[d][1] for d in kept], [held[d][0] for d in kept]))
        rows = []
        for d in sorted({c + k for c in changed if c in held for k in range(window)}):
            own = {e: held[e][1] for e in range(d - window + 1, d + 1) if e in held and held[e][1] is not None}
            mean = sum(own.values()) / len(own) if own else None
            gated = mean if len(own) >= minimum else None
            rows.append((key[0], date.fromordinal(d), gated, math.log(gated) if gated else None, mean if len(own) >= 2 else None, len(own), d - max(own) if own else None, d - min(own) if own else None))
        out = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in COMPOSITE.split(",")])
        yield out.astype({"newest_age": "Int32", "oldest_age": "Int32"})

    state = "days array<int>, values array<double>, versions array<bigint>"
    return daily.select("cell", "day", F.col("value").cast("double").alias("value"), F.col("version").cast("long").alias("version")).groupBy("cell").applyInPandasWithState(update, COMPOSITE, state, "update", GroupStateTimeout.NoTimeout)
