"""Unit conversion and strict parsing of station records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import non_negative

# Unit names of the providers and cubic metres in a cubic foot.
CUBIC_FEET = ("ft^3/s", "ft3/s", "cfs")
CUBIC_METRES = ("m^3/s", "m3/s", "cms")
M3_PER_FT3 = 0.028316846592


def number(text: Column) -> Column:
    """empty is missing, text that is no number too."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def discharge_m3_s(value: Column, unit: Column) -> Column:
    """F13, P13. An unknown unit is an error even where the value is missing; negative values are missing."""
    factor = F.when(unit.isin(*CUBIC_FEET), M3_PER_FT3).when(unit.isin(*CUBIC_METRES), 1.0).otherwise(F.raise_error(F.concat(F.lit("unknown unit: "), F.coalesce(unit, F.lit("null")))).cast("double"))
    return F.when(factor.isNotNull(), non_negative(value * factor))  # the condition looks at the unit whatever the value


def checked(value: Column, **expected: tuple[Column, Column]) -> Column:
    """V9: ``value`` if each (found, wanted) pair is equal, else an error that names the field."""
    out = value
    for name, (found, wanted) in expected.items():
        out = F.when(found.eqNullSafe(wanted), out).otherwise(F.raise_error(F.concat(F.lit(f"record has another {name}: "), F.coalesce(found.cast("string"), F.lit("null")))).cast("double"))
    return out
