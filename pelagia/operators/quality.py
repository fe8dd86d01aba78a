"""Checks that raise, and status roll-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class CheckError(ValueError):
    """Data that may not be used."""


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """A29, V10."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise CheckError(f"repeated {keys}")
    return df


def require_times(times: DataFrame, day: str, expected: int, name: str = "ts") -> DataFrame:
    """V1: one pass over a time axis."""
    t = F.col(name)
    r = times.agg(F.count(t).alias("n"), F.countDistinct(t).alias("d"), F.count(F.when(F.to_date(t) != F.to_date(F.lit(day)), 1)).alias("off")).first()
    if not r.n:
        raise CheckError("no times")
    if r.d != r.n:
        raise CheckError("repeated times")
    if r.off:
        raise CheckError(f"times off {day}")
    if r.n != expected:
        raise CheckError(f"{r.n} times, not {expected}")
    return times


def require_hours(times: DataFrame, step: int = 3, name: str = "ts") -> DataFrame:
    """V2: exactly 0, step, 2 step, ..."""
    found = times.agg(F.array_sort(F.collect_set(F.hour(name))).alias("h")).first().h
    if found != list(range(0, 24, step)):
        raise CheckError(f"hours {found}")
    return times


def require_units(attributes: dict[tuple[str, str], str], variable: str, units: str) -> None:
    """V3."""
    if attributes.get((variable, "units")) != units:
        raise CheckError(f"{variable} is not in {units}")


def require_covered(attributes: dict[tuple[str, str], str], day: str) -> None:
    """V5: no nearest date stands in."""
    start, end = (date.fromisoformat(attributes[("NC_GLOBAL", f"time_coverage_{x}")][:10]) for x in ("start", "end"))
    if not start <= date.fromisoformat(day) <= end:
        raise CheckError(f"{day} is not in {start}..{end}")


def falling(rows: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """V4: rows where an axis does not fall."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(index))
    return rows.withColumn("__before", before).where(F.col(value) >= F.col("__before")).drop("__before")


def require_interval(start: str, end: str, longest: int | None = None) -> None:
    """V14."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days
    if days < 0 or longest is not None and days >= longest:
        raise CheckError(f"{start}..{end}")


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """U8, S19."""
    return expected.select(*keys).join(present.select(*keys), keys, "left_anti")


def status(parts: DataFrame, keys: list[str], failed: str = "failed", errors: str = "errors") -> DataFrame:
    """An exception makes a partition unavailable, errors make it partial."""
    return parts.groupBy(*keys).agg(F.when(F.bool_or(F.col(failed)), "unavailable").when(F.sum(errors) > 0, "partial").otherwise("available").alias("status"))
