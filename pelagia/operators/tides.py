"""Tide heights with astronomical arguments and nodal corrections (F11, A.11).

A constituent's phase follows six angles (hour of the moon, mean longitudes of moon, sun, moon's perigee, its node taken negatively, and
sun's perigee), which are polynomials of time. Lines beside it in the tide's spectrum, its satellites, turn too slowly to be told
apart within a year; together they are a complex factor 1 + sum of ratio * exp(i angle), some with a ratio that follows latitude.
Angles and factors are Column arithmetic over (constituent, time): a small table that is joined to the points' coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days from 1899-12-31 12:00 to 1970-01-01 00:00, UTC.
EPOCH = 25567.5
# Degrees at the epoch, a day, and by the square and cube of ten thousand days, of the five slow angles (published polynomials).
MOON = (270.434164, 13.1763965268, -0.0000850, 0.000000039)
SUN = (279.696678, 0.9856473354, 0.00002267, 0.0)
PERIGEE = (334.329556, 0.1114040803, -0.0007739, -0.00000026)
NODE = (-259.183275, 0.0529539222, -0.0001557, -0.000000050)
SUN_PERIGEE = (281.220844, 0.0000470684, 0.0000339, 0.000000070)
# Of each constituent the multiples of the six angles, the constant phase in cycles, and its satellites from a ratio of 0.0005 on:
# multiples of perigee, node and sun's perigee, phase in cycles, ratio, and how the ratio follows latitude (0 not, 1 diurnal, 2 semidiurnal).
CONSTITUENTS = {
    "M2": ((2, 0, 0, 0, 0, 0), 0.0, [(0, -2, 0, 0.0, 0.0005, 0), (0, -1, 0, 0.5, 0.0373, 0), (1, 0, 0, 0.75, 0.0009, 2), (2, 0, 0, 0.0, 0.0006, 0)]),
    "S2": ((2, 2, -2, 0, 0, 0), 0.0, [(0, -1, 0, 0.0, 0.0022, 0)]),
    "N2": ((2, -1, 0, 1, 0, 0), 0.0, [(-2, -2, 0, 0.5, 0.0039, 0), (-1, 0, 1, 0.0, 0.0008, 0), (0, -2, 0, 0.0, 0.0005, 0), (0, -1, 0, 0.5, 0.0373, 0)]),
    "K2": ((2, 2, 0, 0, 0, 0), 0.0, [(-1, 0, 0, 0.75, 0.0024, 2), (0, -1, 0, 0.5, 0.0128, 0), (0, 1, 0, 0.0, 0.2980, 0), (0, 2, 0, 0.0, 0.0324, 0)]),
    "K1": ((1, 1, 0, 0, 0, 0), -0.75, [(-1, 0, 0, 0.25, 0.0007, 1), (0, -1, 0, 0.5, 0.0198, 0), (0, 1, 0, 0.0, 0.1356, 0), (0, 2, 0, 0.5, 0.0029, 0)]),
    "O1": ((1, -1, 0, 0, 0, 0), -0.25, [(0, -2, 0, 0.5, 0.0058, 0), (0, -1, 0, 0.0, 0.1885, 0), (1, 0, 0, 0.75, 0.0029, 1), (2, 0, 0, 0.5, 0.0064, 0), (2, 1, 0, 0.5, 0.0010, 0)]),
    "P1": ((1, 1, -2, 0, 0, 0), -0.25, [(0, -2, 0, 0.0, 0.0008, 0), (0, -1, 0, 0.5, 0.0112, 0), (2, 0, 0, 0.5, 0.0015, 0)]),
    "Q1": ((1, -2, 0, 1, 0, 0), -0.25, [(-2, -3, 0, 0.5, 0.0007, 0), (-2, -2, 0, 0.5, 0.0039, 0), (-1, -2, 0, 0.75, 0.0010, 1), (-1, -1, 0, 0.75, 0.0115, 1), (-1, 0, 0, 0.75, 0.0292, 1),
                                        (0, -2, 0, 0.5, 0.0057, 0), (-1, 0, 1, 0.0, 0.0008, 0), (0, -1, 0, 0.0, 0.1884, 0), (1, 0, 0, 0.75, 0.0018, 1), (2, 0, 0, 0.5, 0.0028, 0)]),
}
# By kind, how a ratio follows the sine s of latitude: 0.36309 (1 - 5 s^2) / s and 2.59808 s; latitudes nearer to the equator than 5 degrees count as 5.
DIURNAL, SEMIDIURNAL, LEAST_LATITUDE = 0.36309, 2.59808, 5.0


def angles(ts: Column) -> list[Column]:
    """The six angles at ``ts`` (timestamp, UTC), in cycles."""
    days = F.unix_micros(ts) / 86_400_000_000 + EPOCH
    slow = [(a + b * days + c * F.pow(days / 10_000, 2) + d * F.pow(days / 10_000, 3)) / 360 for a, b, c, d in (MOON, SUN, PERIGEE, NODE, SUN_PERIGEE)]
    hour = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000)) / 86_400_000_000
    return [hour + slow[1] - slow[0], *slow]


def arguments(times: DataFrame, names: tuple[str, ...] = tuple(CONSTITUENTS)) -> DataFrame:
    """(ts, constituent, v, re0, im0, re1, im1, re2, im2) of ``times`` (ts): the phase in radians and the sums over satellites by kind."""
    held = times.select("ts", *(a.alias(f"a{k}") for k, a in enumerate(angles(F.col("ts")))))
    turn = lambda cycles: 2 * F.pi() * (cycles - F.floor(cycles))

    def one(name: str) -> Column:
        multiples, phase, satellites = CONSTITUENTS[name]
        parts: dict[str, Column] = {f"{part}{kind}": F.lit(0.0) for kind in range(3) for part in ("re", "im")}
        for p, n, s, own, ratio, kind in satellites:
            at = turn(p * F.col("a3") + n * F.col("a4") + s * F.col("a5") + own)
            parts[f"re{kind}"] += ratio * F.cos(at)
            parts[f"im{kind}"] += ratio * F.sin(at)
        v = turn(sum((m * F.col(f"a{k}") for k, m in enumerate(multiples)), F.lit(phase)))
        return F.struct(F.lit(name).alias("constituent"), v.alias("v"), *(c.alias(k) for k, c in parts.items()))

    return held.select("ts", F.inline(F.array(*(one(n) for n in names))))


def heights(coefficients: DataFrame, times: DataFrame) -> DataFrame:
    """(point, ts, height) of ``coefficients`` (point, lat, constituent, re, im: amplitude times exp(-i Greenwich phase)) at ``times`` (ts).

    A point that lacks a coefficient of a constituent it names, or its latitude, has no heights. ``times`` are the few of a day.
    """
    if unknown := sorted({r.constituent for r in coefficients.select("constituent").distinct().collect()} - set(CONSTITUENTS)):  # names: a handful
        raise ValueError(f"unknown constituents: {unknown}")
    lacking = F.max((F.col("re").isNull() | F.col("im").isNull() | F.col("lat").isNull()).cast("int")).over(Window.partitionBy("point"))
    s = F.sin(F.radians(F.when(F.abs("lat") < LEAST_LATITUDE, F.when(F.col("lat") < 0, -LEAST_LATITUDE).otherwise(LEAST_LATITUDE)).otherwise(F.col("lat"))))
    one, two = DIURNAL * (1 - 5 * s * s) / s, SEMIDIURNAL * s
    rows = coefficients.withColumn("__lacking", lacking).where("__lacking = 0").withColumns({"__one": one, "__two": two}).join(F.broadcast(arguments(times)), "constituent")
    f_re = 1 + F.col("re0") + F.col("__one") * F.col("re1") + F.col("__two") * F.col("re2")
    f_im = F.col("im0") + F.col("__one") * F.col("im1") + F.col("__two") * F.col("im2")
    rows = rows.withColumns({"__re": F.col("re") * f_re - F.col("im") * f_im, "__im": F.col("re") * f_im + F.col("im") * f_re})
    return rows.groupBy("point", "ts").agg(F.sum(F.col("__re") * F.cos("v") - F.col("__im") * F.sin("v")).alias("height"))


def hours_of(spark, day: str) -> DataFrame:
    """(ts, hour) of the 24 hours of a UTC day."""
    return spark.range(24).select(F.timestamp_seconds(F.unix_date(F.to_date(F.lit(day))).cast("long") * 86_400 + F.col("id") * 3600).alias("ts"), F.col("id").cast("int").alias("hour"))
