"""Complex harmonics on a triangle mesh and tides from them (J12, J21, P19, P20, F9-F11, A26, A.10, A.11).

Complex numbers are two columns, re and im.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE, AMBIGUOUS = -1, -2
TOLERANCE, LEAST_AREA, EDGE = 1e-6, 1e-12, 1e-12


def from_polar(amplitude: Column, phase_degrees: Column) -> tuple[Column, Column]:
    """amplitude times exp(-i phase)."""
    return amplitude * F.cos(F.radians(phase_degrees)), -amplitude * F.sin(F.radians(phase_degrees))


def corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their nodes (longitudes in 0-360); slivers and those with a place that is no number are dropped."""
    out = elements
    for k in range(3):
        place = nodes.select(F.col("node").alias(f"n{k}"), F.pmod("lon", F.lit(360.0)).alias(f"x{k}"), F.col("lat").alias(f"y{k}"))
        out = out.join(place, f"n{k}")
    det = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return out.withColumn("det", det).where((F.abs("det") / 2 > LEAST_AREA) & ~F.isnan("det"))  # NaN is above all numbers


def points_in_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(point, tri, w0, w1, w2), edges included; the exact test is barycentric.

    Points and bounding boxes meet in squares, so the range join is an equi-join. A triangle's squares are as wide as the power of two above its
    box, so it lies in four of them at most however large it is, and small triangles are in squares of their own size; a point looks into one square of each size that the mesh has.
    """
    low, high = (lambda a: F.least(*(F.col(f"{a}{k}") for k in range(3)))), (lambda a: F.greatest(*(F.col(f"{a}{k}") for k in range(3))))
    boxes = triangles.where(high("x") - low("x") < 180.0)  # one that spans more crosses the meridian of its axis
    extent = F.greatest(high("x") - low("x"), high("y") - low("y"), F.lit(1e-6))
    boxes = boxes.withColumn("__level", F.ceil(F.log2(extent)).cast("int"))
    square = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    boxes = boxes.withColumn("__gx", F.explode(F.sequence(square(low("x")), square(high("x"))))).withColumn("__gy", F.explode(F.sequence(square(low("y")), square(high("y")))))
    levels = triangles.sparkSession.range(-20, 9).select(F.col("id").cast("int").alias("__level")).join(boxes.select("__level"), "__level", "left_semi")  # 29 at most
    placed = points.select("point", F.pmod("lon", F.lit(360.0)).alias("__x"), F.col("lat").alias("__y")).crossJoin(F.broadcast(levels))
    placed = placed.withColumns({"__gx": square(F.col("__x")), "__gy": square(F.col("__y"))})
    met = placed.join(boxes, ["__level", "__gx", "__gy"])
    dx, dy = F.col("__x") - F.col("x0"), F.col("__y") - F.col("y0")
    w1 = (dx * (F.col("y2") - F.col("y0")) - dy * (F.col("x2") - F.col("x0"))) / F.col("det")
    w2 = (dy * (F.col("x1") - F.col("x0")) - dx * (F.col("y1") - F.col("y0"))) / F.col("det")
    met = met.withColumns({"w1": w1, "w2": w2}).withColumn("w0", 1.0 - F.col("w1") - F.col("w2"))
    return met.where((F.col("w0") >= -EDGE) & (F.col("w1") >= -EDGE) & (F.col("w2") >= -EDGE)).select("point", "tri", "n0", "n1", "n2", "w0", "w1", "w2")


def interpolate(points: DataFrame, nodes: DataFrame, elements: DataFrame, harmonics: DataFrame) -> DataFrame:
    """A.10: (point, constituent, re, im, triangle). triangle is -1 outside the mesh and -2 where triangles disagree, both without values; else the smallest triangle id."""
    inside = points_in_triangles(points, corners(elements, nodes))
    each = inside.select("point", "tri", F.explode(F.array(*(F.struct(F.col(f"n{k}").alias("node"), F.col(f"w{k}").alias("w")) for k in range(3)))).alias("c"))
    values = each.join(harmonics.withColumnRenamed("node", "__node"), F.col("c.node") == F.col("__node"))
    values = values.groupBy("point", "tri", "constituent").agg(F.sum(F.col("c.w") * F.col("re")).alias("re"), F.sum(F.col("c.w") * F.col("im")).alias("im"))
    first = Window.partitionBy("point", "constituent").orderBy("tri").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    values = values.withColumns({"__re": F.first("re").over(first), "__im": F.first("im").over(first)})
    values = values.groupBy("point", "constituent").agg(F.min("tri").alias("tri"), F.first("__re").alias("re"), F.first("__im").alias("im"), F.max(F.hypot(F.col("re") - F.col("__re"), F.col("im") - F.col("__im"))).alias("__off"))
    odd = F.max("__off").over(Window.partitionBy("point")) > TOLERANCE
    values = values.withColumn("__odd", odd).select("point", "constituent", F.when(~F.col("__odd"), F.col("re")).alias("re"), F.when(~F.col("__odd"), F.col("im")).alias("im"), F.when(F.col("__odd"), AMBIGUOUS).otherwise(F.col("tri")).alias("triangle"))
    names = harmonics.select("constituent").distinct()
    return points.select("point").crossJoin(F.broadcast(names)).join(values, ["point", "constituent"], "left").withColumn("triangle", F.coalesce("triangle", F.lit(OUTSIDE)))  # names: a handful of constituents


# Speeds of the constituents in degrees an hour (published tables).
SPEEDS = {"M2": 28.9841042, "S2": 30.0, "N2": 28.4397295, "K2": 30.0821373, "K1": 15.0410686, "O1": 13.9430356, "P1": 14.9589314, "Q1": 13.3986609}


def predict(coefficients: DataFrame, times: DataFrame, speeds: DataFrame, epoch_hours: str = "hours") -> DataFrame:
    """F11, A.11: height = sum of Re(coefficient f exp(i (v + speed t))) over constituents; a point that lacks a coefficient has none.

    ``speeds`` (constituent, speed, f, v): nodal factor f and equilibrium argument v in degrees are given by the caller
    (1 and 0 give the plain harmonic sum). ``times`` and ``speeds`` are small dimension tables.
    """
    complete = Window.partitionBy("point")
    rows = coefficients.withColumn("__missing", F.max(F.col("re").isNull().cast("int")).over(complete)).where("__missing = 0").join(F.broadcast(speeds), "constituent").crossJoin(F.broadcast(times))
    angle = F.radians(F.col("v") + F.col("speed") * F.col(epoch_hours))
    return rows.groupBy("point", epoch_hours).agg(F.sum(F.col("f") * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).alias("height"))


def daily_range(heights: DataFrame, samples: int = 24) -> DataFrame:
    """A11, model variant: all samples must be there."""
    return heights.groupBy("point").agg(F.when(F.count("height") == samples, F.max("height") - F.min("height")).alias("hourly_range"))
