"""Long-form rasters (t, y, x): stencils, complete samples, reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collocated_speed(raster: DataFrame, u: str = "u", v: str = "v", wet: Column | None = None, time: tuple[str, ...] = ("t",)) -> DataFrame:
    """A.3: speed at cell centres of a staggered grid. Each component is the mean of a cell's own face and the one before it;
    the first column and row, gaps in the axis and missing faces give NULL. One sort by row and one by column."""
    row, column = Window.partitionBy(*time, "y").orderBy("x"), Window.partitionBy(*time, "x").orderBy("y")
    uc = F.when(F.col("x") - F.lag("x").over(row) == 1, (F.col(u) + F.lag(u).over(row)) / 2)
    vc = F.when(F.col("y") - F.lag("y").over(column) == 1, (F.col(v) + F.lag(v).over(column)) / 2)
    return raster.withColumn("__uc", uc).withColumn("__vc", vc).withColumn("speed", F.when(wet if wet is not None else F.lit(True), F.hypot("__uc", "__vc"))).drop("__uc", "__vc")


def complete_samples(samples: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Mean and maximum over time, only where all ``expected`` samples are present."""
    x, full = F.col(value), F.count(value) == expected
    return samples.groupBy(*keys).agg(F.count(value).alias("valid_samples"), F.when(full, F.avg(x)).alias("sample_mean"), F.when(full, F.max(x)).alias("sample_max"), F.when(full, F.max(x) - F.min(x)).alias("sample_range"))


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join of rasters whose coordinates must be the same; a place that only one has is an error."""
    both = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), keys, "full")
    one = F.col("__l").isNull() | F.col("__r").isNull()
    fine = F.when(one, F.raise_error(F.lit("coordinates differ"))).otherwise(F.lit(True)).cast("boolean")
    return both.where(fine).drop("__l", "__r")


def flatten(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """One row a pixel of two small axes. Axes are coordinate lists, not data; Spark broadcasts the smaller."""
    return lats.crossJoin(lons)


def wide_to_long(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """P25."""
    return rows.unpivot(keys, columns, name, value)


def surface(raster: DataFrame, depth: str = "depth_index") -> DataFrame:
    """P26."""
    return raster.where(F.col(depth) == 0).drop(depth)


def station_range(samples: DataFrame, keys: list[str], value: str, minimum: int) -> DataFrame:
    """Peak to peak, given at least ``minimum`` samples."""
    x = F.col(value)
    return samples.groupBy(*keys).agg(F.count(value).alias("sample_count"), F.when(F.count(value) >= minimum, F.max(x) - F.min(x)).alias("value_range"))


def on_day(samples: DataFrame, day: str, name: str = "ts") -> DataFrame:
    """Samples of one day; no other day stands in."""
    return samples.where(F.to_date(F.col(name)) == F.to_date(F.lit(day)))
