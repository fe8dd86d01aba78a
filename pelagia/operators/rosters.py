"""Rosters, first matches, unions of unlike rows, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import CheckError, require_unique


def first_match(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a told order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def roster_values(roster: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Each roster row with its one feature or NULLs; more than one is an error."""
    return roster.join(require_unique(features, keys), keys, "left")


def require_inventory(roster: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Each roster row must be in the inventory."""
    if not (lost := roster.join(inventory, keys, "left_anti")).isEmpty():
        raise CheckError(f"not in the inventory: {lost.select(*keys).limit(5).collect()}")
    return roster.join(inventory, keys)


def bag_union(parts: list[DataFrame], kind: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Rows of all parts, with NULL for columns that a part lacks, and a column that names the part."""
    if kind and names:
        parts = [p.withColumn(kind, F.lit(n)) for p, n in zip(parts, names, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def probes(points: DataFrame, features: DataFrame, cell: str = "cell") -> DataFrame:
    """Named cells with their feature row and whether the support has them."""
    return points.join(features.withColumn("in_support", F.lit(True)), cell, "left").fillna(False, ["in_support"])


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """J20."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
