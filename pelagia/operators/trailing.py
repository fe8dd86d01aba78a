"""Trailing composites that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(cells: DataFrame, days: DataFrame) -> DataFrame:
    """Every cell on every day: both are dimension tables, so the product is the size of the result."""
    return cells.crossJoin(days)


def date_spine(spark, start: str, end: str, name: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias(name))


def compact_day(day: Column) -> Column:
    """20240701, as providers want it in requests."""
    return F.date_format(day, "yyyyMMdd")


def trailing_composite(daily: DataFrame, calendar: DataFrame, cell: str, day: str, value: str, window: int = 7, minimum: int = 1) -> DataFrame:
    """Equal-weight mean of the positive values of the last ``window`` days per cell, with its log, the variant from two days on,
    the days used and the ages of the newest and oldest. One shuffle by cell; the range frame ends today."""
    n = F.unix_date(day)
    x = F.when(F.col(value) > 0, F.col(value))
    over = Window.partitionBy(cell).orderBy("__n").rangeBetween(-(window - 1), 0)
    rows = calendar.join(daily, [cell, day], "left").withColumn("__n", n).withColumn("__x", x)
    mean, count, at = F.avg("__x").over(over), F.count("__x").over(over), F.when(F.col("__x").isNotNull(), F.col("__n"))
    rows = rows.withColumns({"__mean": mean, "valid_days": count, "newest_age": F.col("__n") - F.max(at).over(over), "oldest_age": F.col("__n") - F.min(at).over(over)})
    gated = F.when(F.col("valid_days") >= minimum, F.col("__mean"))
    return rows.withColumns({"trailing_mean": gated, "trailing_log_mean": F.ln(gated), "trailing_2plus_mean": F.when(F.col("valid_days") >= 2, F.col("__mean")), "window_days": F.lit(window)}).drop("__n", "__x", "__mean")
