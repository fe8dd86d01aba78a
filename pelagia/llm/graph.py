"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Scratch


#: From this many links on, minima are written before they are joined.
MANY = 1 << 20
#: Rows of (node, number) that may be broadcast: 16 bytes each, counted before.
FEW = 1 << 18


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame, around: DataFrame, few: bool, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links every larger neighbour to the smallest one around each node (large star), then each node and its smaller neighbours (small star).
    Minima are summed in the map tasks first, so hubs cost one row a task. A ``few`` are broadcast, so that no link moves for a join;
    ``written`` ones let Spark split a hub's rows in the join, as both sides then come straight from a shuffle."""
    sent = F.broadcast if few else lambda df: df
    least = around.select("a", F.least("low", "a").alias("m"))
    large = _both(edges).join(sent(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a row a link at most
    large = large if few else written(large.distinct(), "large")
    least = written(large.groupBy("a").agg(F.min("b").alias("m")), "min-small")
    moved = large.join(sent(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (x, y); the component is its smallest node."""
    edges = links.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    edges = scratch.table(edges, f"{name}-0")
    k, count = 0, edges.count()
    while True:
        k += 1
        parts: list[str] = []

        def written(df: DataFrame, part: str) -> DataFrame:
            if count < MANY:
                return df
            parts.append(f"{name}-{k}-{part}")  # noqa: B023
            return scratch.table(df, parts[-1])  # noqa: B023

        around = written(_both(edges).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count(F.lit(1)).alias("links")), "around")
        # In stars a node with a smaller neighbour has no other one: then each knows its component, and no round is needed to see that nothing moves.
        nodes, ends, apart = around.agg(F.count(F.lit(1)), F.sum("links"), F.count_if(F.expr("low < a and high > low"))).first()
        if not apart:
            return around.select(F.col("a").alias("node"), F.least("low", "a").alias("component"))
        count = ends // 2
        edges = scratch.table(_stars(edges, around, nodes <= FEW and count < MANY, written), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", *parts)


def merged(known: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``known`` components (node, component) after further ``links`` (x, y): those of the components are found, so earlier links are not followed again.
    ``known`` is a written table."""
    sent = F.broadcast if known.count() <= FEW else lambda df: df
    for end in ("x", "y"):
        own = sent(known.select(F.col("node").alias(end), "component"))
        links = links.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    found = scratch.table(components(links, scratch, name), f"{name}-found")
    sent = F.broadcast if found.count() <= FEW else lambda df: df
    higher = sent(found.select(F.col("node").alias("component"), F.col("component").alias("higher")))
    moved = known.join(higher, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    return moved.unionByName(found.join(known.select("node"), "node", "left_anti"))
