"""Sources against each other; they are never blended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import parent


def agreement(pairs: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """A18-A21 over rows where both are present. NULL correlation where either does not vary."""
    o, p = F.col(observed), F.col(predicted)
    both = pairs.where(o.isNotNull() & p.isNotNull())
    covariance = F.covar_pop(o, p)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(o).alias("mean_observed"), F.avg(p).alias("mean_predicted"), F.avg(F.abs(o - p)).alias("mae"),
        F.sqrt(F.var_pop(o - p)).alias("demeaned_rmse"), F.try_divide(covariance, F.stddev_pop(o) * F.stddev_pop(p)).alias("correlation"),
        ((F.max(p) - F.min(p)) - (F.max(o) - F.min(o))).alias("range_error"))


def on_spine(spine: DataFrame, series: DataFrame, keys: list[str], name: str = "hour") -> DataFrame:
    """Values at the spine's times, NULL where there is none; a repeated time is an error."""
    once = series.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n"), F.first("value").alias("value"))
    once = once.withColumn("value", F.when(F.col("__n") > 1, F.raise_error(F.lit("repeated time")).cast("double")).otherwise(F.col("value"))).drop("__n")
    return series.select(*keys).distinct().crossJoin(F.broadcast(spine)).join(once, [*keys, name], "left")


def station_status(triangle: Column, complete: Column) -> Column:
    """A.12."""
    return F.when(triangle < 0, "outside_or_ambiguous_native_mesh").when(~complete, "reference_incomplete").otherwise("compared")


def with_parent_value(cells: DataFrame, coarse: DataFrame, value: str, child_resolution: int, parent_resolution: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each cell with the value of its parent, where ``keys`` (a day) agree too."""
    up = coarse.select(F.col("cell").alias("__parent"), *keys, F.col(value))
    return cells.withColumn("__parent", parent(F.col("cell"), child_resolution, parent_resolution)).join(up, ["__parent", *keys], "left").drop("__parent")


def complementary(cells: DataFrame, original: Column, broader: Column, area: str = "area", keys: tuple[str, ...] = ()) -> DataFrame:
    """Shares of the area that the original, the broader source, or either covers."""
    a = F.col(area)
    share = lambda c: F.try_divide(F.coalesce(F.sum(F.when(c, a)), F.lit(0.0)), F.sum(a))
    o, b = F.coalesce(original, F.lit(False)), F.coalesce(broader, F.lit(False))
    return cells.groupBy(*keys).agg(share(o).alias("original_fraction"), share(b).alias("broader_fraction"), share(o | b).alias("either_fraction"))
