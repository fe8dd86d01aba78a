"""Distances over water (A16, J13-J15, P9, P10, W6, F28, A.6)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import covers_segment, nearest_on
from ..sinks.scratch import Scratch


def canonical_edges(edges: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Passable edges with both ends in the support, once each, with the least length in km."""
    out = edges.where("passable")
    if support is not None:
        cells = support.select("cell").distinct()
        out = out.join(cells.withColumnRenamed("cell", "source"), "source", "left_semi").join(cells.withColumnRenamed("cell", "target"), "target", "left_semi")
    return out.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg((F.min("distance_m") / 1000.0).alias("km"))


def graph_nodes(support: DataFrame) -> DataFrame:
    """P10: NULL eligibility is no."""
    return support.where(F.coalesce("eligible", F.lit(False)) & (F.col("degree") > 0))


def utm10(lon: Column, lat: Column) -> tuple[Column, Column]:
    """easting and northing of UTM zone 10 north by Krueger's series (WGS 84), to millimetres within the zone."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon + 123.0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(alpha)), F.lit(0.0))
    return 500000.0 + 0.9996 * a * east, 0.9996 * a * north


def nearest_nodes(seeds: DataFrame, nodes: DataFrame, k: int, limit_km: float) -> DataFrame:
    """Up to ``k`` nearest nodes within ``limit_km`` of each seed (x, y in metres), nearest first; ties go to the smaller cell.

    Nodes and seeds meet in grid squares of the limit's size, so a seed sees the nine squares around it.
    """
    if not limit_km > 0:
        raise ValueError("the limit is a length")
    size = limit_km * 1000.0
    square = lambda c: F.floor(F.col(c) / size)
    near = F.sequence(F.lit(-1), F.lit(1))
    tour = seeds.withColumn("__gx", F.explode(F.transform(near, lambda d: square("x") + d))).withColumn("__gy", F.explode(F.transform(near, lambda d: square("y") + d)))
    placed = nodes.select("cell", F.col("x").alias("__x"), F.col("y").alias("__y"), square("x").alias("__gx"), square("y").alias("__gy"))
    met = tour.join(placed, ["__gx", "__gy"]).withColumn("snap_km", F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")) / 1000.0)
    met = met.where(F.col("snap_km") <= size / 1000.0)
    order = F.row_number().over(Window.partitionBy("seed").orderBy("snap_km", "cell"))
    return met.withColumn("choice", order).where(F.col("choice") <= k).drop("__gx", "__gy", "__x", "__y")


def snap_seeds(seeds: DataFrame, nodes: DataFrame, coast: DataFrame, limit_km: float = 8.0, tolerance_m: float = 100.0, k: int = 30) -> DataFrame:
    """A.6, J13, J14: (seed, cell, connector_km, status). seeds: seed, x, y, coast_limit_m; coast: seed, water (WKB of the water around it).

    A seed starts at the nearest water point if that is within its limit, and takes the first of its ``k`` nearest
    nodes whose straight connector stays in the water widened by the tolerance; else it is ``unmapped``.
    """
    shore = seeds.join(coast, "seed", "left").withColumn("__at", nearest_on("water", "x", "y"))
    close = F.col("__at.distance") <= F.col("coast_limit_m")
    start = shore.select("seed", F.when(close, F.col("__at.x")).otherwise(F.col("x")).alias("x"), F.when(close, F.col("__at.y")).otherwise(F.col("y")).alias("y"), F.col("__at.distance").alias("coast_m"), "water", F.coalesce(close, F.lit(False)).alias("close"))
    tried = nearest_nodes(start.where("close"), nodes, k, limit_km).join(nodes.select("cell", F.col("x").alias("__nx"), F.col("y").alias("__ny")), "cell")
    good = tried.where(covers_segment("water", "x", "y", "__nx", "__ny", F.lit(float(tolerance_m))))
    best = good.groupBy("seed").agg(F.min_by(F.struct("cell", (F.col("snap_km") + F.col("coast_m") / 1000.0).alias("connector_km")), "choice").alias("b"))
    return start.select("seed").join(best, "seed", "left").select("seed", "b.cell", "b.connector_km", F.when(F.col("b").isNotNull(), "mapped").otherwise("unmapped").alias("status"))


def dissolve(cells: DataFrame, parent: str, ring: str = "ring") -> DataFrame:
    """Outline segments of each parent. Cells that touch share segments with equal ends; those that two cells have lie inside.
    ``ring``: array of (x, y) structs, first point repeated at the end."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    each = cells.select(parent, F.explode(pairs).alias("s")).select(parent, F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))
    return each.groupBy(parent, "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def outlines(cells: DataFrame, parent: str, ring: str = "ring") -> DataFrame:
    """Closed rings of each parent's outline: (parent, part, points, area, hole). Rings of ``cells`` run counter-clockwise; so do outer rings here, holes the other way.

    Sides of cells are directed; those inside a parent are there in both directions and go. Each other side points to the one that goes on from its end (the
    leftmost where parts touch in a point). Rings are named by their smallest side, and sides numbered within them, by pointers that double each round, so rounds follow the logarithm of the longest ring.
    """
    scratch = Scratch(cells.sparkSession, "outlines")
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))
    each = cells.select(F.col(parent).alias("parent"), F.explode(pairs).alias("s")).select("parent", "s.a", "s.b")
    once = each.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).groupBy("parent", "lo", "hi").agg(F.sum(F.when(F.col("a") == F.col("lo"), 1).otherwise(-1)).alias("way")).where("way <> 0")
    sides = once.select("parent", F.when(F.col("way") > 0, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("way") > 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))
    sides = scratch.table(sides.withColumn("id", F.monotonically_increasing_id()), "sides")
    heading = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    on = sides.select("parent", F.col("a").alias("b"), F.col("id").alias("next"), heading.alias("out"))
    turn = F.pmod(F.col("out") - F.col("into") + F.pi(), 2 * F.pi())
    going = sides.select("parent", "b", "id", heading.alias("into")).join(on, ["parent", "b"]).groupBy("id").agg(F.max_by("next", turn).alias("next"))
    now, k = scratch.table(going.select("id", "next", F.least("id", "next").alias("least")), "rings-0"), 0
    first = now.select("id", F.col("next").alias("step"))
    while True:
        k += 1
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("least").alias("other"))
        now = scratch.table(now.join(ahead, "next").select("id", F.col("far").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), f"rings-{k}")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    named = now.select("id", "least").join(first, "id").withColumn("next", F.when(F.col("step") != F.col("least"), F.col("step")))  # a ring ends before its smallest side
    now, k = scratch.table(named.select("id", "least", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")), "places-0"), 0
    while not now.where("next is not null").isEmpty():
        k += 1
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        now = scratch.table(now.join(ahead, "next", "left").select("id", "least", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), f"places-{k}")
    placed = sides.join(now.select("id", "least", "left"), "id")
    rings = placed.groupBy("parent", "least").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "a"))).alias("s"), (F.sum(F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")) / 2).alias("area"))
    part = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("area"), "least"))
    return rings.select(F.col("parent").alias(parent), part.alias("part"), F.concat(F.col("s.a"), F.slice("s.a", 1, 1)).alias("points"), "area", (F.col("area") < 0).alias("hole"))


#: A graph of at most this many edges is searched whole in each seed's task; 24 bytes each.
CORE = 100_000
#: Cells of more neighbours stay: taking out one of three or fewer never adds edges.
MOST_NEIGHBOURS = 3
#: Seeds that are searched together in one block.
SEEDS = 64


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "km").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "km"))


def _apart(ways: DataFrame, number: int) -> DataFrame:
    """Cells (a) of few neighbours of which no two are neighbours: those that come before all of theirs by degree, then by a hash; then the same among what is left."""
    degree = ways.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_NEIGHBOURS)
    rank = degree.select("a", F.struct("n", F.xxhash64("a", F.lit(number)).alias("h"), F.col("a").alias("at")).alias("own"))
    known = ways.select("a", "b").join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("own").alias("other")), "b", "left")
    first = known.groupBy("a").agg(F.first("own").alias("own"), F.min("other").alias("least")).where("least is null or own < least").select("a")
    beside = ways.join(first, "a", "left_semi").select(F.col("b").alias("a")).unionByName(first).distinct()
    left = known.join(beside, "a", "left_anti").join(beside.withColumnRenamed("a", "b"), "b", "left_anti")
    alone = rank.join(beside, "a", "left_anti").join(left.groupBy("a").agg(F.min("other").alias("least")), "a", "left").where("least is null or own < least").select("a")
    return first.unionByName(alone)


def contract(edges: DataFrame, scratch: Scratch, core: int = CORE, cutoff_km: float | None = None) -> tuple[list[DataFrame], DataFrame, int]:
    """Takes cells out of a graph until ``core`` edges are left, without changing a distance between those that stay.

    Each round takes out cells that are no neighbours and joins the neighbours of each by a way through it. Given back are, by round, the taken
    cells' ways (cell, up, km) to what was still there, then the edges (a, b, km) that are left, and their number. It ends early where hardly any cell has few enough neighbours.
    """
    now = scratch.table(edges.where("a <> b and km is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("km").alias("km")), "edges-0")
    levels: list[DataFrame] = []
    many = now.count()
    while many > core:
        k = len(levels) + 1
        ways = _both_ways(now)
        out = scratch.table(_apart(ways, k), f"taken-{k}")
        up = scratch.table(ways.join(out, "a").select(F.col("a").alias("cell"), F.col("b").alias("up"), "km"), f"up-{k}")
        kept = now.join(out, "a", "left_anti").join(out.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b", "km")
        other = up.select("cell", F.col("up").alias("b"), F.col("km").alias("rest"))
        through = up.join(other, "cell").where("up < b").select(F.col("up").alias("a"), "b", (F.col("km") + F.col("rest")).alias("km"))
        through = through if cutoff_km is None else through.where(F.col("km") <= cutoff_km)
        now = scratch.table(kept.unionByName(through).groupBy("a", "b").agg(F.min("km").alias("km")), f"edges-{k}")
        levels.append(up)
        before, many = many, now.count()
        if many > before * 0.98:
            break
    return levels, now, many


def _nearer(beside: dict, best: dict, queue: list[tuple]) -> dict:
    """Shortest ways over a small graph from the (distance, cell) in ``queue``; gives what came nearer than ``best`` and keeps it there."""
    came: dict = {}
    for d, cell in queue:
        if d < best.get(cell, math.inf):
            best[cell] = came[cell] = d
    heapq.heapify(queue)
    while queue:
        d, cell = heapq.heappop(queue)
        if d > best[cell]:
            continue
        for other, km in beside.get(cell, ()):
            if d + km < best.get(other, math.inf):
                best[other] = came[other] = d + km
                heapq.heappush(queue, (d + km, other))
    return came


def _neighbours(edges: Iterable[tuple]) -> dict[object, list[tuple[object, float]]]:
    beside: dict[object, list[tuple[object, float]]] = {}
    for a, b, km in edges:
        beside.setdefault(a, []).append((b, km))
        beside.setdefault(b, []).append((a, km))
    return beside


def _searched(core: list[tuple]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Shortest ways from a seed's cells over a small graph."""
    beside = _neighbours(core)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        came = _nearer(beside, {}, list(zip(rows["distance"].tolist(), rows["cell"].tolist(), strict=True)))
        return pd.DataFrame({"seed": key[0], "cell": list(came), "distance": list(came.values())})

    return run


def _by_blocks(edges: DataFrame, found: DataFrame, block: Callable[[Column], Column], scratch: Scratch, cutoff_km: float | None) -> DataFrame:
    """Distances over a graph too large for one task. A round searches whole blocks of cells that something came nearer in, and hands the improved
    cells on over the edges between blocks: rounds follow the blocks that a way crosses, and what moves is the rows of blocks that changed."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    inside = F.col("block") == F.col("other")
    told = edges.select("a", "b", "km", block(F.col("a")).alias("block"), block(F.col("b")).alias("other"))
    inner = scratch.table(told.where(inside).select("block", "a", "b", "km"), "inner")
    cross = scratch.table(_both_ways(told.where(~inside)).withColumnRenamed("a", "cell"), "cross")
    parts = max(1, -(-found.select("seed").distinct().count() // SEEDS))
    part = F.pmod(F.xxhash64("seed"), F.lit(parts))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        beside, out = _neighbours(right[["a", "b", "km"]].itertuples(index=False, name=None)), []
        for seed, rows in left.groupby("seed", sort=False):
            old, new = rows[~rows["fresh"]], rows[rows["fresh"]]
            came = _nearer(beside, dict(zip(old["cell"], old["distance"], strict=True)), list(zip(new["distance"].tolist(), new["cell"].tolist(), strict=True)))
            out.append(pd.DataFrame({"seed": seed, "cell": list(came), "distance": list(came.values())}))
        return pd.concat(out) if out else left[["seed", "cell", "distance"]].iloc[:0]

    least = lambda df: df.groupBy("seed", "cell").agg(F.min("distance").alias("distance"))
    come, held = scratch.table(found, "come-0"), []
    while not come.isEmpty():
        k = len(held) + 1
        fresh = come.select("seed", "cell", "distance", block(F.col("cell")).alias("block"), F.lit(True).alias("fresh"))
        touched = scratch.table(fresh.select("block").distinct(), f"touched-{k}")
        rows = fresh
        if held:
            before = reduce(DataFrame.unionByName, held).withColumn("block", block(F.col("cell"))).join(touched, "block", "left_semi")
            rows = rows.unionByName(before.groupBy("seed", "cell", "block").agg(F.min("distance").alias("distance")).withColumn("fresh", F.lit(False)))
        ways = inner.join(touched, "block", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        got = rows.withColumn("part", part).groupBy("block", "part").cogroup(ways.groupBy("block", "part")).applyInPandas(search, f"seed {kinds['seed']}, cell {kinds['cell']}, distance double")
        held.append(scratch.table(got if cutoff_km is None else got.where(F.col("distance") <= cutoff_km), f"held-{k}"))
        step = held[-1].join(cross, "cell").select("seed", F.col("b").alias("cell"), (F.col("distance") + F.col("km")).alias("distance"))
        step = least(step if cutoff_km is None else step.where(F.col("distance") <= cutoff_km))
        known = least(reduce(DataFrame.unionByName, held).join(step.select("cell").distinct(), "cell", "left_semi")).withColumnRenamed("distance", "old")
        come = scratch.table(step.join(known, ["seed", "cell"], "left").where("old is null or distance < old").drop("old"), f"come-{k}")
    return least(reduce(DataFrame.unionByName, held)) if held else found


def water_distances(edges: DataFrame, starts: DataFrame, connectors: DataFrame | None = None, cutoff_km: float | None = None, core: int = CORE, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """(seed, cell, distance) of every reachable cell: the shortest way from the seed's nodes plus their connector lengths.

    ``edges`` (a, b, km), ``starts`` (seed, cell, connector_km). The graph is contracted first, for all seeds at once (``contract``): rounds grow with the
    logarithm of its chains, not with the longest way. Seeds climb from their cells to those that are left, ways among these are found in a task a seed, and distances
    come back down, each level from the ones above it. A graph that is still of more than ``core`` edges (a wide plane of cells) is searched by ``block``s: a function of a
    cell that puts neighbours together, such as an ancestor some levels up; each cell is its own block by default. ``connectors`` (cell, target, connector_km) override the graph distance by one hop (J15).
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "water")
    within = lambda df: df if cutoff_km is None else df.where(F.col("distance") <= cutoff_km)
    least = lambda df: df.groupBy("seed", "cell").agg(F.min("distance").alias("distance"))
    levels, left, many = contract(edges, scratch, core, cutoff_km)
    first = F.coalesce(F.col("connector_km").cast("double"), F.lit(0.0))
    begun = scratch.table(least(starts.select("seed", "cell", first.alias("distance"))), "begun")
    found = within(begun)
    for k, up in enumerate(levels, 1):
        step = found.join(up, "cell").select("seed", F.col("up").alias("cell"), (F.col("distance") + F.col("km")).alias("distance"))
        found = scratch.table(least(within(found.unionByName(step))), f"climbed-{k}")
    if many <= max(core, CORE):
        graph = [(r.a, r.b, r.km) for r in left.toLocalIterator()]  # CORE edges at most
        kinds = {f.name: f.dataType.simpleString() for f in found.schema}
        done = within(found.groupBy("seed").applyInPandas(_searched(graph), f"seed {kinds['seed']}, cell {kinds['cell']}, distance double"))
    else:
        done = _by_blocks(left, found, block or (lambda cell: cell), scratch, cutoff_km)
    taken = [up.select("cell").distinct() for up in levels]
    parts = [scratch.table(reduce(lambda rows, cells: rows.join(cells, "cell", "left_anti"), taken, done).select("seed", "cell", "distance"), "core")]
    for k in range(len(levels), 0, -1):
        above = reduce(DataFrame.unionByName, parts).withColumnRenamed("cell", "up")
        via = levels[k - 1].join(above, "up").select("seed", "cell", (F.col("km") + F.col("distance")).alias("distance"))
        own = found.join(taken[k - 1], "cell", "left_semi").select("seed", "cell", "distance")
        parts.append(scratch.table(least(within(via.unionByName(own))), f"down-{k}"))
    done = reduce(DataFrame.unionByName, parts)
    if cutoff_km is not None:  # a seed's own cell is its own however long the connector
        done = done.unionByName(begun.where(F.col("distance") > cutoff_km).join(done.select("seed", "cell"), ["seed", "cell"], "left_anti"))
    if connectors is None:
        return done
    hop = connectors.select(F.col("cell").alias("__end"), F.col("target").alias("cell"), F.col("connector_km").alias("__km"))
    ends = done.join(hop, "cell").select("seed", F.col("__end").alias("cell"), (F.col("distance") + F.col("__km")).alias("distance"))
    return done.join(connectors.select("cell"), "cell", "left_anti").select("seed", "cell", "distance").unionByName(ends)
