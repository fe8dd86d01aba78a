from __future__ import annotations

import numpy as np
import pytest
from pelagia.functions import geometry as g
from pelagia.operators import water
from pyspark.sql import functions as F

SQUARE = np.array([[0, 0], [1000, 0], [1000, 1000], [0, 1000], [0, 0]], float)


def test_polygons():
    parts = g.rings(g.to_wkb([SQUARE, SQUARE / 4 + 100]))  # with a hole
    p = np.array([[500.0, 500.0], [200.0, 200.0], [1100.0, 500.0]])
    assert g.inside(parts, p).tolist() == [True, False, False]
    at, far = g.nearest(parts, p)
    assert far.tolist() == [0, 100, 100] and at[2].tolist() == [1000, 500]
    assert g.covers([SQUARE], np.array([10.0, 10.0]), np.array([900.0, 900.0]), 50)
    assert g.covers([SQUARE], np.array([10.0, 10.0]), np.array([1040.0, 10.0]), 50) and not g.covers([SQUARE], np.array([10.0, 10.0]), np.array([1100.0, 10.0]), 50)
    assert g.area(g.clip(SQUARE, (500, -10, 2000, 600))) == 500 * 600 and len(g.clip(SQUARE, (2000, 0, 3000, 10))) == 0
    with pytest.raises(ValueError):
        g.rings(b"\x01\x01\x00\x00\x00" + b"\0" * 16)


def test_seeds_snap(spark):
    f = spark.createDataFrame
    water_wkb = bytearray(g.to_wkb([SQUARE]))
    seeds = f([("in", 500.0, 500.0, 200.0), ("shore", 1100.0, 500.0, 200.0), ("land", 5000.0, 500.0, 200.0), ("alone", 500.0, 500.0, 200.0)], "seed string, x double, y double, coast_limit_m double")
    coast = f([(s, water_wkb) for s in ("in", "shore", "land")], "seed string, water binary")
    nodes = f([(1, 600.0, 500.0), (2, 1090.0, 1500.0)], "cell long, x double, y double")
    got = {r.seed: (r.cell, r.connector_km and round(r.connector_km, 6), r.status) for r in water.snap_seeds(seeds, nodes, coast).collect()}
    assert got == {"in": (1, 0.1, "mapped"), "shore": (1, 0.5, "mapped"), "land": (None, None, "unmapped"), "alone": (None, None, "unmapped")}


def test_dissolve(spark):
    box = lambda x: [(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)]
    cells = spark.createDataFrame([(1, box(0)), (1, box(1)), (2, box(5))], "p int, ring array<struct<x:int,y:int>>")
    assert {r.p: r.n for r in water.dissolve(cells, "p").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 6, 2: 4}


def near_polygon(parts, p, tolerance):
    return g.nearest(parts, p[None])[1][0] <= tolerance


def star(rng, n, r, at=(0.0, 0.0)):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    out = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(r / 3, r, n)[:, None] + at
    return np.concatenate([out, out[:1]])


def test_cover_of_random_polygons():
    """Against dense points: what they refute is refuted, and what is refuted has a point beyond the tolerance on it."""
    rng = np.random.default_rng(3)
    seen = {True: 0, False: 0}
    for _ in range(1500):
        parts = [star(rng, rng.integers(5, 12), 100.0)] + ([star(rng, 5, 20.0)] if rng.random() < 0.5 else [])
        start, end = rng.uniform(-110, 110, (2, 2))
        if rng.random() < 0.3:
            start, end = rng.uniform(-40, 40, (2, 2))
        tolerance = float(rng.choice([0.0, 3.0, 15.0, 60.0]))
        far = g.nearest(parts, start + np.linspace(0, 1, 4001)[:, None] * (end - start))[1]
        got = g.covers(parts, start, end, tolerance)
        seen[got] += 1
        assert not got if far.max() > tolerance + 1e-9 else got or far.max() > tolerance - 0.2
    assert min(seen.values()) > 200
    gap = [np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]) * 1e6, np.array([[5e5, 0], [5e5 + 1e-3, 0], [5e5 + 1e-3, 1e6], [5e5, 1e6], [5e5, 0]])]
    assert not g.covers(gap, np.array([1.0, 5e5]), np.array([9e5, 5e5]), 1e-4) and g.covers(gap, np.array([1.0, 5e5]), np.array([9e5, 5e5]), 1e-3)  # a cut of a millimetre in a thousand kilometres
    assert g.covers([SQUARE], np.array([5.0, 5.0]), np.array([5.0, 5.0]), 0) and not g.covers([SQUARE], np.array([-5.0, 5.0]), np.array([-5.0, 5.0]), 4)


def test_simpler_lines():
    rng = np.random.default_rng(5)
    for _ in range(60):
        line = np.cumsum(rng.normal(size=(rng.integers(2, 80), 2)), 0)
        if rng.random() < 0.5:
            line = np.concatenate([line, line[:1]])
        short = g.simplify(line, 1.5)
        assert (short[0] == line[0]).all() and (short[-1] == line[-1]).all() and len(short) <= len(line)
        assert (g.nearest([short], line)[1] <= 1.5 + 1e-9).all() or len(short) == 1 or g.inside([short], line).any()
    assert len(g.simplify(np.array([[0, 0], [1, 0.01], [2, 0], [3, 0.01], [4, 0]]), 0.1)) == 2


def test_valid_rings():
    bow = np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float)
    assert g.valid([SQUARE, SQUARE / 4 + 100]) and g.valid([star(np.random.default_rng(1), 40, 5.0)])
    for bad in (bow, SQUARE[:3], SQUARE[:4], np.zeros((5, 2)), np.where(SQUARE == 1000, np.nan, SQUARE), np.array([[0, 0], [2, 0], [2, 0], [0, 2], [0, 0]], float), np.array([[0, 0], [4, 0], [4, 4], [2, 0], [0, 4], [0, 0]], float)):
        assert not g.valid([bad])


def test_polygon_columns(spark):
    wkb = bytearray(g.to_wkb([SQUARE, SQUARE / 2 + 100]))
    bow = bytearray(g.to_wkb([np.array([[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]], float)]))
    df = spark.createDataFrame([(1, wkb), (2, None), (3, bow)], "k int, w binary")
    got = {r.k: r for r in df.select("k", g.clipped("w", (0, 0, 400, 2000)).alias("c"), g.simplified("w", 1.0).alias("s"), g.is_valid("w").alias("v")).collect()}
    assert [got[k].v for k in (1, 2, 3)] == [True, None, False] and got[2].c is None and got[2].s is None
    outer, hole = g.rings(bytes(got[1].c))
    assert g.area(outer) - g.area(hole) == 400 * 1000 - 300 * 500 and len(g.rings(bytes(got[1].s))[0]) == 5
    assert df.select(g.clipped("w", (5000, 0, 6000, 1)).alias("c")).where("c is not null").count() == 0


def test_outlines(spark):
    """Two parts, a hole, corners that touch; the rings' areas add up to the cells'."""
    box = lambda x, y: [(float(i), float(j)) for i, j in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y))]
    ring = [(1, box(x, y)) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 1))] + [(1, box(10, 10)), (1, box(11, 11)), (2, box(0, 0))]
    cells = spark.createDataFrame(ring, "p int, ring array<struct<x:double,y:double>>")
    got = water.outlines(cells, "p").collect()
    assert sorted((r.p, r.area, r.hole, len(r.points) - 1) for r in got) == [(1, -2.0, True, 6), (1, 1.0, False, 4), (1, 1.0, False, 4), (1, 16.0, False, 16), (2, 1.0, False, 4)]
    for r in got:
        points = [(q.x, q.y) for q in r.points]
        assert points[0] == points[-1] and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(points, points[1:], strict=False))
        assert r.area == pytest.approx(sum(a * d - c * b for (a, b), (c, d) in zip(points, points[1:], strict=False)) / 2)
    assert [r.part for r in sorted(got, key=lambda r: (r.p, r.part))] == [1, 2, 3, 4, 1] and water.outlines(cells.limit(0), "p").count() == 0


def test_projection_and_back(spark):
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(-126.5, -119.5, 500), rng.uniform(0, 80, 500)
    east, north = g.to_utm(lon, lat)
    back = g.from_utm(east, north)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9  # a tenth of a millimetre
    e, n = water.utm10(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), strict=True))[:50], "lon double, lat double").select(e.alias("e"), n.alias("n")).collect()
    assert max(abs(r.e - x) + abs(r.n - y) for r, x, y in zip(got, east, north, strict=False)) < 1e-3
    one = spark.createDataFrame([(bytearray(g.to_wkb([np.array([[-123, 48], [-122, 48], [-122, 49], [-123, 48]], float)])),), (None,)], "w binary")
    moved = [r.w for r in one.select(g.projected(g.projected("w"), back=True).alias("w")).collect()]
    assert np.abs(g.rings(bytes(moved[0]))[0] - [[-123, 48], [-122, 48], [-122, 49], [-123, 48]]).max() < 1e-9 and moved[1] is None
