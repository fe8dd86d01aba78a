"""Exponential influence of sources on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def influence(distances: DataFrame, values: DataFrame, scale: float, cutoff: float = 3.0, normalize: bool = False, cell: str = "cell", seed: str = "seed") -> DataFrame:
    """Per cell: expected and available sources, their share, the value and the nearest source in range.

    ``distances`` (seed, cell, distance) has no row where a cell can't be reached. A value is NULL unless all
    expected sources have one. The cut-off is a filter on the distance scan; sums are combined before the shuffle.
    """
    near = distances.where(F.col("distance") <= scale * cutoff).join(values, seed, "left")
    w, v = F.exp(-F.col("distance") / scale), F.col("value")
    total = F.try_divide(F.sum(w * v), F.sum(w)) if normalize else F.sum(w * v)
    return near.groupBy(cell).agg(
        F.count(F.lit(1)).alias("expected_sources"), F.count(v).alias("available_sources"), F.try_divide(F.count(v), F.count(F.lit(1))).alias("source_completeness"),
        F.when(F.count(v) == F.count(F.lit(1)), total).alias("value"), F.min("distance").alias("nearest_source"))


def influence_on(support: DataFrame, distances: DataFrame, values: DataFrame, scale: float, cutoff: float = 3.0, normalize: bool = False, cell: str = "cell") -> DataFrame:
    """Every support row; cells out of range of all sources expect 0 and have no value."""
    return support.join(influence(distances, values, scale, cutoff, normalize, cell), cell, "left").fillna(0, ["expected_sources", "available_sources"])
