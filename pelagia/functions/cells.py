"""Hierarchical cells.

``parent`` is the public bit layout of H3 ids as Column arithmetic: the resolution is the nibble at
bit 52, the digit of resolution r sits at bit 3 (15 - r), unused digits are 7. ``hex_cell`` computes the ids, an Arrow
batch at a time. ``grid_cell`` gives a latitude-longitude quadtree in the same bit layout, which shares ``parent`` but is not H3.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hexagons import cell_centres, cell_ids

RESOLUTION_BITS = 15 << 52


def to_long(cell: Column) -> Column:
    return F.conv(cell, 16, 10).cast("long")


def to_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def resolution(cell: Column) -> Column:
    return F.shiftright(cell.bitwiseAND(F.lit(RESOLUTION_BITS)), 52).cast("int")


def parent(cell: Column, child_resolution: int, parent_resolution: int) -> Column:
    """Id of the ancestor; NULL stays NULL."""
    if not 0 <= parent_resolution <= child_resolution <= 15:
        raise ValueError("a parent is coarser than its child")
    unused = ((1 << 3 * (child_resolution - parent_resolution)) - 1) << 3 * (15 - child_resolution)
    return cell.bitwiseAND(F.lit(~RESOLUTION_BITS)).bitwiseOR(F.lit(parent_resolution << 52)).bitwiseOR(F.lit(unused))


def grid_cell(lat: Column, lon: Column, res: int) -> Column:
    """Quadtree fallback: one digit (0-3) a level from the halves of both axes, in H3's bit layout."""
    y, x = (lat + 90.0) / 180.0, F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
    steps = 1 << res
    iy = F.least(F.floor(y * steps), F.lit(steps - 1))
    ix = F.least(F.floor(x * steps), F.lit(steps - 1))
    out = F.lit((1 << 59) | (res << 52) | ((1 << 3 * (15 - res)) - 1))
    for r in range(1, res + 1):
        digit = F.shiftright(iy, res - r).bitwiseAND(F.lit(1)) * 2 + F.shiftright(ix, res - r).bitwiseAND(F.lit(1))
        out = out.bitwiseOR(F.shiftleft(digit, 3 * (15 - r)))
    return F.when(lat.between(-90, 90) & lon.isNotNull(), out)


def hex_cell(lat: Column, lon: Column, res: int) -> Column:
    """the H3 id of a place; NULL where latitude or longitude is absent, not finite, or the latitude beyond 90 degrees."""
    if not 0 <= res <= 15:
        raise ValueError("resolutions are 0 to 15")

    @F.pandas_udf("long")
    def cell(lat: pd.Series, lon: pd.Series) -> pd.Series:
        y, x = lat.to_numpy(float), lon.to_numpy(float)
        good = np.isfinite(y) & np.isfinite(x) & (np.abs(y) <= 90)
        out = np.zeros(len(y), np.int64)
        out[good] = cell_ids(y[good], x[good], res)
        return pd.Series(pd.arrays.IntegerArray(out, ~good))

    return cell(lat.cast("double"), lon.cast("double"))


def hex_centre(cell: Column) -> Column:
    """Centre of an H3 cell as a struct (lat, lon) in degrees; NULL stays NULL."""

    @F.pandas_udf("struct<lat:double,lon:double>")
    def centre(cell: pd.Series) -> pd.DataFrame:
        good = cell.notna().to_numpy()
        out = np.full((len(cell), 2), np.nan)
        out[good] = np.stack(cell_centres(cell[good].to_numpy(np.int64)), 1)
        return pd.DataFrame(out, columns=["lat", "lon"])

    return F.when(cell.isNotNull(), centre(cell))


def indexer(res: int, system: str = "grid"):
    """A function (lat, lon) -> cell Column, of H3 (``h3``) or of the quadtree (``grid``)."""
    return lambda lat, lon: (hex_cell if system == "h3" else grid_cell)(lat, lon, res)
