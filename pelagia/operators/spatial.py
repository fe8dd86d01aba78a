"""Masked aggregation of pixels on cells and roll-ups through the cell hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = 0.5


def weighted_mean(x: Column, w: Column) -> Column:
    """A2: over rows where x is present; NULL if there are none."""
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def wet(support: DataFrame, overlap: str = "has_water_overlap") -> DataFrame:
    """Cells that touch water; where that is not known, they don't."""
    return support.where(F.coalesce(F.col(overlap), F.lit(False)))


def aggregate_pixels(pixels: DataFrame, support: DataFrame, metrics: list[str], cell: str = "cell", weight: Column | None = None) -> DataFrame:
    """Each support row with pixel counts and, per metric, the weighted mean and the count of valid pixels.

    One shuffle of per-cell sums: pixels are filtered by the support and combined before they move; cells
    without pixels keep counts of 0 and NULL metrics.
    """
    w = weight if weight is not None else F.cos(F.radians(F.col("lat")))
    inside = pixels.join(support.select(cell), cell, "left_semi")
    sums = inside.groupBy(cell).agg(F.count(F.lit(1)).alias("input_pixel_count"), *(c for m in metrics for c in (weighted_mean(F.col(m), w).alias(m), F.count(m).alias(f"{m}_valid_pixels"))))
    counts = ["input_pixel_count", *(f"{m}_valid_pixels" for m in metrics)]
    return support.join(sums, cell, "left").fillna(0, counts)


def roll_up(children: DataFrame, parent: str, area: str = "area", counted: str | None = None) -> DataFrame:
    """A4, A5: area sums by parent, and the number of children under the name ``counted``."""
    return children.groupBy(parent).agg(F.sum(area).alias(area), *([F.count(F.lit(1)).alias(counted)] if counted else []))


def gated_roll_up(children: DataFrame, parent: str, metric: str, area: str = "area", missing_source: Column | None = None, gate: float = GATE, diagnostics: tuple[str, ...] = ()) -> DataFrame:
    """Area-weighted mean over children with a value, given at least ``gate`` of the area and no child that lacks a source."""
    a, m = F.col(area), F.col(metric)
    means = (weighted_mean(F.when(a > 0, F.col(d)), a).alias(f"mean_{d}") for d in diagnostics)
    sums = children.groupBy(parent).agg(
        F.sum(a).alias(area), F.coalesce(F.sum(F.when(m.isNotNull(), a)), F.lit(0.0)).alias("__valid"), F.sum(m * a).alias("__sum"),
        F.bool_or(missing_source if missing_source is not None else F.lit(False)).alias("missing_source"), *means)
    fraction = F.try_divide("__valid", area)
    value = F.when((fraction >= gate) & ~F.coalesce("missing_source", F.lit(False)), F.try_divide("__sum", "__valid"))
    return sums.withColumns({"supported_fraction": fraction, metric: value}).drop("__valid", "__sum")


def coverage(cells: DataFrame, metrics: list[str], area: str = "area") -> DataFrame:
    """Per metric the valid and all cells, and the valid share of the area; one pass, then one row a metric."""
    a = F.col(area)
    sums = cells.agg(F.count(F.lit(1)).alias("total_cells"), F.sum(a).alias("__area"),
                     *(c for k, m in enumerate(metrics) for c in (F.count(m).alias(f"__n{k}"), F.coalesce(F.sum(F.when(F.col(m).isNotNull(), a)), F.lit(0.0)).alias(f"__a{k}"))))
    stacked = ", ".join(f"'{m}', __n{k}, __a{k}" for k, m in enumerate(metrics))
    return sums.selectExpr("total_cells", "__area", f"stack({len(metrics)}, {stacked}) as (metric, valid_cells, __valid)").select(
        "metric", "valid_cells", "total_cells", F.try_divide("__valid", "__area").alias("valid_area_fraction"))
