"""Tide heights against plain arithmetic, and nodal factors against the published approximations."""

from __future__ import annotations

import cmath
import math
from datetime import UTC, datetime, timedelta

import pytest
from pelagia.operators import tides
from pyspark.sql import functions as F


def plain(at: datetime, lat: float, coefficients: dict[str, complex]) -> float:
    d = (at - datetime(1899, 12, 31, 12, tzinfo=UTC)) / timedelta(days=1)
    turn = [(c0 + c1 * d + c2 * (d / 1e4) ** 2 + c3 * (d / 1e4) ** 3) / 360 for c0, c1, c2, c3 in (tides.MOON, tides.SUN, tides.PERIGEE, tides.NODE, tides.SUN_PERIGEE)]
    own = [(at - datetime(at.year, at.month, at.day, tzinfo=UTC)) / timedelta(days=1) + turn[1] - turn[0], *turn]
    s = math.sin(math.radians(math.copysign(max(abs(lat), 5), lat)))
    by_latitude = (1, 0.36309 * (1 - 5 * s * s) / s, 2.59808 * s)
    total = 0.0
    for name, c in coefficients.items():
        multiples, phase, satellites = tides.CONSTITUENTS[name]
        f = 1 + sum(r * by_latitude[kind] * cmath.exp(2j * math.pi * (p * own[3] + n * own[4] + q * own[5] + ph)) for p, n, q, ph, r, kind in satellites)
        total += (f * c * cmath.exp(2j * math.pi * (sum(m * a for m, a in zip(multiples, own, strict=True)) + phase))).real
    return total


def test_heights_against_plain_arithmetic(spark):
    names = list(tides.CONSTITUENTS)
    points = {1: 48.5, 2: -33.0, 3: 0.0, 4: 2.0}
    coefficients = {(p, n): cmath.rect(2.0 / (k + 1), -math.radians(37 * p + 50 * k)) for p in points for k, n in enumerate(names)}
    rows = [(p, points[p], n, c.real, c.imag) for (p, n), c in coefficients.items()] + [(5, 10.0, "M2", None, 1.0), (5, 10.0, "S2", 1.0, 1.0), (6, None, "M2", 1.0, 0.0)]
    table = spark.createDataFrame(rows, "point int, lat double, constituent string, re double, im double")
    for day in ("2024-07-01", "1999-12-31", "2033-02-28"):
        hours = tides.hours_of(spark, day)
        assert [r.hour for r in hours.orderBy("ts").collect()] == list(range(24))
        got = tides.heights(table, hours.select("ts")).withColumn("s", F.unix_seconds("ts")).collect()
        assert len(got) == 24 * len(points)
        for r in got:
            want = plain(datetime.fromtimestamp(r.s, UTC), points[r.point], {n: coefficients[r.point, n] for n in names})
            assert abs(r.height - want) < 1e-6
    assert tides.heights(table.limit(0), hours.select("ts")).count() == 0
    with pytest.raises(ValueError):
        tides.heights(table.withColumn("constituent", F.lit("M99")), hours.select("ts"))


def test_speeds_of_the_constituents(spark):
    """The phase of an hour later is that of the published speeds."""
    from pelagia.operators.harmonics import SPEEDS

    v = {(r.constituent, r.h): r.v for r in tides.arguments(tides.hours_of(spark, "2024-07-01").where("hour < 2").select("ts")).withColumn("h", F.hour("ts")).collect()}
    for name, speed in SPEEDS.items():
        assert abs(math.degrees(v[name, 1] - v[name, 0]) % 360 - speed) < 1e-4


@pytest.mark.parametrize(("name", "f", "u"), [
    ("M2", lambda n: 1 - 0.037 * math.cos(n), lambda n: -2.1 * math.sin(n)),
    ("K1", lambda n: 1.006 + 0.115 * math.cos(n) - 0.009 * math.cos(2 * n), lambda n: -8.9 * math.sin(n) + 0.7 * math.sin(2 * n)),
    ("O1", lambda n: 1.009 + 0.187 * math.cos(n) - 0.015 * math.cos(2 * n), lambda n: 10.8 * math.sin(n) - 1.3 * math.sin(2 * n) + 0.2 * math.sin(3 * n)),
    ("K2", lambda n: 1.024 + 0.286 * math.cos(n) + 0.008 * math.cos(2 * n), lambda n: -17.7 * math.sin(n) + 0.7 * math.sin(2 * n))])
def test_nodal_factors_near_the_published_approximations(spark, name, f, u):
    """Classical series in the longitude of the moon's node, over a whole turn of 18.6 years."""
    days = spark.range(60).select(F.timestamp_seconds(946684800 + F.col("id") * 86400 * 115).alias("ts"))
    s = math.sin(math.radians(49.0))
    for r in tides.arguments(days).where(F.col("constituent") == name).withColumn("d", F.unix_seconds("ts") / 86400 + tides.EPOCH).collect():
        node = -math.radians(tides.NODE[0] + tides.NODE[1] * r.d + tides.NODE[2] * (r.d / 1e4) ** 2)
        got = complex(1 + r.re0 + 0.36309 * (1 - 5 * s * s) / s * r.re1 + 2.59808 * s * r.re2, r.im0 + 0.36309 * (1 - 5 * s * s) / s * r.im1 + 2.59808 * s * r.im2)
        assert abs(abs(got) - f(node)) < 0.025 and abs(math.degrees(cmath.phase(got)) - u(node)) < 1.5
