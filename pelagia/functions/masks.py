"""Column masks: a value that fails a check becomes NULL, its row stays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUALITY_MAX = 5
SST_RANGE = (-3.0, 45.0)
SPEED_LIMIT = 100.0


def present(x: Column) -> Column:
    """F5, the source boundary: NaN and infinities are missing, zero is a value."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quality_band(x: Column, flag: Column, least: int) -> Column:
    """P1."""
    return F.when(flag.between(least, QUALITY_MAX), x)


def positive(x: Column) -> Column:
    """P2, P15."""
    return F.when(x > 0, x)


def physical(x: Column, low: float = SST_RANGE[0], high: float = SST_RANGE[1]) -> Column:
    """P3."""
    return F.when(x.between(low, high), x)


def magnitude(x: Column, limit: float = SPEED_LIMIT) -> Column:
    """P4."""
    return F.when(F.abs(x) < limit, x)


def wet(x: Column, depth: Column) -> Column:
    """P5."""
    return F.when(depth > 0, x)


def non_negative(x: Column) -> Column:
    """Zero stays."""
    return F.when(x >= 0, present(x))


def log_of(x: Column) -> Column:
    """F1 on positive values."""
    return F.ln(positive(x))


def longitude_360(lon: Column) -> Column:
    """F8."""
    return F.pmod(lon, F.lit(360.0))


def longitude_180(lon: Column) -> Column:
    """F8."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def any_present(*columns: Column) -> Column:
    """The status of a feature row."""
    found = F.lit(False)
    for c in columns:
        found = found | c.isNotNull()
    return F.when(found, "available").otherwise("unavailable")


def scale_name(prefix: str, scale: float) -> str:
    """10.0 names 10KM, 2.5 names 2.5KM."""
    return f"{prefix}_{scale:g}KM"
