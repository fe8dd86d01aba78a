"""Small fixtures with expected values for the marine operators."""

from __future__ import annotations

import math

import pytest
from pelagia.functions import cells, masks, units
from pelagia.operators import comparison, grid, harmonics, kernel, quality, rosters, spatial, trailing, water
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(df):
    return df.first()


def test_zero_is_a_value_and_missing_stays(spark):
    px = spark.createDataFrame([(48.5, -123.5, 0.0, 1)], "lat double, lon double, sst double, cell long")
    support = spark.createDataFrame([(1, 10.0), (2, 20.0)], "cell long, area double")
    out = {r.cell: r for r in spatial.aggregate_pixels(px, support, ["sst"]).collect()}
    assert out[1].sst == 0 and out[1].sst_valid_pixels == 1
    assert out[2].sst is None and out[2].sst_valid_pixels == 0 and out[2].input_pixel_count == 0


def test_weights_follow_each_metric(spark):
    px = spark.createDataFrame([(0.0, 1.0, None, 1), (60.0, 4.0, 5.0, 1), (10.0, None, None, 9)], "lat double, a double, b double, cell long")
    out = one(spatial.aggregate_pixels(px, spark.createDataFrame([(1,)], "cell long"), ["a", "b"]))
    assert out.a == pytest.approx((1 + 4 * 0.5) / 1.5) and out.b == pytest.approx(5) and out.input_pixel_count == 2
    none = spatial.aggregate_pixels(px.limit(0), spark.createDataFrame([(1,)], "cell long"), ["a"]).collect()
    assert [(r.input_pixel_count, r.a) for r in none] == [(0, None)]


@pytest.mark.parametrize(("values", "normalize", "want"), [([100.0, 50.0], False, [100.0, 150 / math.e, None]), ([100.0, None], False, [100.0, None, None]), ([2.0, 4.0], True, [2.0, 3.0, None])])
def test_kernel(spark, values, normalize, want):
    distances = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 1, 10.0)], "seed int, cell int, distance double")
    seeds = spark.createDataFrame(list(enumerate(values)), "seed int, value double")
    support = spark.createDataFrame([(0,), (1,), (2,)], "cell int")
    out = [r for r in kernel.influence_on(support, distances, seeds, 10.0, 3.0, normalize).orderBy("cell").collect()]
    assert [r.value for r in out] == [None if w is None else pytest.approx(w) for w in want]
    assert [r.expected_sources for r in out] == [1, 2, 0]
    if values[1] is None:
        assert out[1].available_sources == 1 and out[1].nearest_source == 10 and out[1].source_completeness == 0.5


def test_kernel_decays(spark):
    d = spark.createDataFrame([(0, c, float(c)) for c in range(40)], "seed int, cell int, distance double")
    out = [r.value for r in kernel.influence(d, spark.createDataFrame([(0, 7.0)], "seed int, value double"), 5.0).orderBy("cell").collect()]
    assert len(out) == 16 and all(a > b for a, b in zip(out, out[1:]))


def raster(spark, hole=False):
    rows = [(t, y, x, None if hole and (t, y, x) == (0, 1, 0) else 3.0, 4.0, not (y == 2 and x == 2)) for t in range(2) for y in range(3) for x in range(3)]
    return spark.createDataFrame(rows, "t int, y int, x int, u double, v double, wet boolean")


def test_collocation(spark):
    speed = {(r.t, r.y, r.x): r.speed for r in grid.collocated_speed(raster(spark), wet=F.col("wet")).collect()}
    assert speed[0, 1, 1] == 5 and all(v is None for (t, y, x), v in speed.items() if x == 0 or y == 0 or (y, x) == (2, 2))
    assert {(r.t, r.y, r.x): r.speed for r in grid.collocated_speed(raster(spark, True)).collect()}[0, 1, 1] is None


def test_gap_in_an_axis_is_no_neighbour(spark):
    r = spark.createDataFrame([(0, 0, 0, 1.0, 1.0), (0, 0, 2, 1.0, 1.0), (0, 1, 2, 1.0, 1.0)], "t int, y int, x int, u double, v double")
    assert all(x.speed is None for x in grid.collocated_speed(r).collect())


def test_complete_samples(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 1.0), (2, None)], "k int, v double")
    out = {r.k: r for r in grid.complete_samples(rows, ["k"], "v", 2).collect()}
    assert (out[1].sample_mean, out[1].sample_max, out[2].sample_mean, out[2].valid_samples) == (2, 3, None, 1)


def test_alignment_and_reshaping(spark):
    a, b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "x int, u double"), spark.createDataFrame([(0, 5.0), (2, 6.0)], "x int, v double")
    with pytest.raises(PySparkException):
        grid.aligned(a, b, ["x"]).collect()
    assert grid.aligned(a.where("x = 0"), b.where("x = 0"), ["x"]).collect()[0].v == 5
    assert grid.flatten(spark.range(3), spark.range(2).toDF("b")).count() == 6
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double")
    assert sorted(map(tuple, grid.wide_to_long(wide, ["k"], ["a", "b"], "m", "v").collect())) == [(1, "a", 2.0), (1, "b", 3.0)]
    assert grid.surface(spark.createDataFrame([(0, 1.0), (1, 2.0)], "depth_index int, v double")).collect()[0].v == 1


def test_discharge(spark):
    rows = spark.createDataFrame([("S-1", "100", "ft^3/s"), ("S-1", None, "m3/s"), ("S-1", "0", "m3/s"), ("S-1", "-4", "m3/s"), ("S-1", "", "m3/s")], "station string, value string, unit string")
    v = units.discharge_m3_s(units.checked(units.number(F.col("value")), station=(F.col("station"), F.lit("S-1"))), F.col("unit"))
    got = [r.v for r in rows.select(v.alias("v")).collect()]
    assert got[0] == pytest.approx(2.8316846592) and got[1:] == [None, 0.0, None, None]
    for odd in (("S-2", "1", "m3/s"), ("S-1", "1", "furlong"), ("S-1", None, "furlong")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([odd], rows.schema).select(v.alias("v")).collect()


def test_trailing(spark):
    rows = [("2024-06-25", "a", 2.0), ("2024-06-30", "a", 4.0), ("2024-07-01", "a", 6.0), ("2024-07-02", "a", 1000.0), ("2024-06-30", "b", 3.0), ("2024-07-02", "b", 1000.0)]
    daily = spark.createDataFrame(rows, "day string, cell string, x double").withColumn("day", F.to_date("day"))
    calendar = trailing.spine(spark.createDataFrame([("a",), ("b",), ("c",)], "cell string"), trailing.date_spine(spark, "2024-06-25", "2024-07-02"))
    out = {r.cell: r for r in trailing.trailing_composite(daily, calendar, "cell", "day", "x", 7, 2).where("day = '2024-07-01'").collect()}
    a, b, c = out["a"], out["b"], out["c"]
    assert (a.trailing_mean, a.valid_days, a.newest_age, a.oldest_age) == (4, 3, 0, 6) and a.trailing_log_mean == pytest.approx(math.log(4))
    assert (b.trailing_mean, b.trailing_2plus_mean, b.newest_age) == (None, None, 1)
    assert (c.trailing_mean, c.valid_days, c.newest_age) == (None, 0, None)


def test_water_graph(spark):
    support = spark.createDataFrame([(k, k < 4, 1) for k in range(5)] + [(9, None, 1)], "cell long, eligible boolean, degree int")
    raw = spark.createDataFrame([(0, 1, 1000.0, True), (1, 0, 900.0, True), (2, 3, 1000.0, True), (1, 2, 5.0, False), (3, 77, 1.0, True)], "source long, target long, distance_m double, passable boolean")
    edges = water.canonical_edges(raw, support)
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 0.9), (2, 3, 1.0)]
    assert sorted(r.cell for r in water.graph_nodes(support).collect()) == [0, 1, 2, 3]
    starts = spark.createDataFrame([("left", 0, 0.5)], "seed string, cell long, connector_km double")
    got = {r.cell: r.distance for r in water.water_distances(edges, starts).collect()}
    assert got == {0: 0.5, 1: pytest.approx(1.4)}  # the other basin has no row
    ends = spark.createDataFrame([(7, 1, 0.25), (1, 0, 3.0)], "cell long, target long, connector_km double")
    got = {r.cell: r.distance for r in water.water_distances(edges, starts, ends).collect()}
    assert got == {0: 0.5, 7: pytest.approx(1.65), 1: pytest.approx(3.5)}  # one hop over graph distances


def test_snapping_and_projection(spark):
    p = spark.createDataFrame([(-123.0, 48.5), (-123.1, 48.51)], "lon double, lat double")
    east, north = water.utm10(F.col("lon"), F.col("lat"))
    got = p.select(east.alias("e"), north.alias("n")).collect()
    assert got[0].e == pytest.approx(500000, abs=1e-6) and got[0].n == pytest.approx(5371846.3, abs=2000)
    assert math.hypot(got[1].e - got[0].e, got[1].n - got[0].n) == pytest.approx(7470, rel=0.01)
    seeds = spark.createDataFrame([("s", 0.0, 0.0)], "seed string, x double, y double")
    nodes = spark.createDataFrame([(1, 100.0, 0.0), (2, -100.0, 0.0), (3, 7000.0, 0.0), (4, 9000.0, 0.0)], "cell long, x double, y double")
    assert [r.cell for r in water.nearest_nodes(seeds, nodes, 30, 8.0).orderBy("choice").collect()] == [1, 2, 3]


MESH = dict(nodes=[(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0)], elements=[(0, 0, 1, 2)])


def interpolated(spark, nodes, elements, h, point):
    f = spark.createDataFrame
    return one(harmonics.interpolate(f([(0, *point)], "point int, lon double, lat double"), f(nodes, "node int, lon double, lat double"), f(elements, "tri int, n0 int, n1 int, n2 int"), f(h, "node int, constituent string, re double, im double")))


def test_phase_wraps(spark):
    h = [(k, "M2", math.cos(math.radians(p)), -math.sin(math.radians(p))) for k, p in enumerate((179, -179, 179))]
    got = interpolated(spark, **MESH, h=h, point=(0.5, 0.0))
    assert got.re < -0.99 and abs(got.im) < 1e-10 and got.triangle == 0
    out = interpolated(spark, **MESH, h=h, point=(2.0, 2.0))
    assert out.re is None and out.triangle == harmonics.OUTSIDE


def test_overlap_and_dateline(spark):
    nodes = MESH["nodes"] + [(k + 3, x, y) for k, x, y in MESH["nodes"]]
    h = [(k, "M2", 1.0 + k // 3, 0.0) for k in range(6)]
    both = [(0, 0, 1, 2), (1, 3, 4, 5)]
    assert interpolated(spark, nodes, both, h, (0.2, 0.2)).triangle == harmonics.AMBIGUOUS
    same = [(k, "M2", 1.0, 0.0) for k in range(6)]
    assert tuple(interpolated(spark, nodes, both, same, (0.2, 0.2)))[2:] == (1.0, 0.0, 0)
    far = [(0, -179.0, 48.0), (1, 179.0, 48.0), (2, -179.0, 50.0)]
    assert interpolated(spark, far, [(0, 0, 1, 2)], same[:3], (-123.0, 49.0)).triangle == harmonics.OUTSIDE
    assert interpolated(spark, far, [(0, 0, 1, 2)], same[:3], (-179.5, 48.2)).triangle == 0


def test_prediction(spark):
    f = spark.createDataFrame
    c = f([(0, "M2", 2.0, 0.0), (0, "S2", 1.0, 0.0), (1, "M2", 1.0, 0.0), (1, "S2", None, None)], "point int, constituent string, re double, im double")
    speeds = f([("M2", 28.9841042, 1.0, 0.0), ("S2", 30.0, 1.0, 0.0)], "constituent string, speed double, f double, v double")
    heights = harmonics.predict(c, spark.range(24).select(F.col("id").cast("double").alias("hours")), speeds)
    got = {r.hours: r.height for r in heights.collect()}
    assert len(got) == 24 and got[0.0] == pytest.approx(3) and got[6.0] == pytest.approx(2 * math.cos(math.radians(6 * 28.9841042)) - 1)
    assert one(harmonics.daily_range(heights)).hourly_range == pytest.approx(max(got.values()) - min(got.values()))


def test_roll_up_gates(spark):
    rows = [(1, 10.0, 5.0, 1, 1), (1, 10.0, None, 0, 0), (2, 4.0, 5.0, 1, 1), (2, 6.0, None, 0, 0), (3, 10.0, 5.0, 1, 2), (4, 0.0, 5.0, 1, 1)]
    ch = spark.createDataFrame(rows, "p int, area double, m double, available int, expected int")
    out = {r.p: r for r in spatial.gated_roll_up(ch, "p", "m", missing_source=F.col("available") < F.col("expected"), diagnostics=("expected",)).collect()}
    assert (out[1].m, out[2].m, out[3].m, out[4].m) == (5, None, None, None)
    assert out[1].supported_fraction == 0.5 and out[1].mean_expected == 0.5 and out[2].supported_fraction == 0.4
    assert spatial.roll_up(ch, "p").agg(F.sum("area")).first()[0] == sum(r[1] for r in rows)


def test_coverage(spark):
    c = spark.createDataFrame([(1.0, 1.0, None), (3.0, None, None)], "area double, a double, b double")
    assert [tuple(r) for r in spatial.coverage(c, ["a", "b"]).collect()] == [("a", 1, 2, 0.25), ("b", 0, 2, 0.0)]


def test_agreement(spark):
    rows = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 4.0), (1, None, 9.0), (2, 5.0, 1.0), (2, 5.0, 2.0)], "k int, o double, p double")
    out = {r.k: r for r in comparison.agreement(rows, ["k"], "o", "p").collect()}
    assert (out[1].n, out[1].mae, out[1].demeaned_rmse, out[1].range_error) == (2, 2, 0, 0) and out[1].correlation == pytest.approx(1)
    assert out[2].correlation is None and out[2].range_error == 1
    assert comparison.agreement(rows.limit(0), ["k"], "o", "p").count() == 0


def test_complementary_and_status(spark):
    c = spark.createDataFrame([(1.0, True, None), (1.0, None, True), (2.0, False, False)], "area double, a boolean, b boolean")
    assert tuple(one(comparison.complementary(c, F.col("a"), F.col("b")))) == (0.25, 0.25, 0.5)
    s = spark.createDataFrame([(-2, True), (0, False), (0, True)], "t int, full boolean").select(comparison.station_status(F.col("t"), F.col("full")).alias("s")).collect()
    assert [r.s for r in s] == ["outside_or_ambiguous_native_mesh", "reference_incomplete", "compared"]
    hours = spark.createDataFrame([("x", 1, 2.0), ("x", 1, 3.0)], "k string, hour int, value double")
    with pytest.raises(PySparkException):
        comparison.on_spine(spark.range(2).select(F.col("id").cast("int").alias("hour")), hours, ["k"]).collect()


def test_parents(spark):
    cell = spark.createDataFrame([("8928308280fffff",)], "c string").select(cells.to_long(F.col("c")).alias("c"))
    out = one(cell.select(cells.resolution(F.col("c")).alias("r"), cells.to_text(cells.parent(F.col("c"), 9, 8)).alias("r8"), cells.to_text(cells.parent(F.col("c"), 9, 6)).alias("r6")))
    assert tuple(out) == (9, "8828308281fffff", "86283082fffffff")
    p = spark.createDataFrame([(48.5, -123.5), (-90.0, 180.0), (None, 1.0)], "lat double, lon double")
    got = p.select(cells.parent(cells.grid_cell(F.col("lat"), F.col("lon"), 8), 8, 6).alias("up"), cells.grid_cell(F.col("lat"), F.col("lon"), 6).alias("own")).collect()
    assert all(r.up == r.own for r in got) and got[2].own is None
    value = comparison.with_parent_value(p.limit(1).select(cells.grid_cell(F.col("lat"), F.col("lon"), 8).alias("cell")), p.limit(1).select(cells.grid_cell(F.col("lat"), F.col("lon"), 5).alias("cell"), F.lit(3.0).alias("v")), "v", 8, 5)
    assert one(value).v == 3
    with pytest.raises(ValueError):
        cells.parent(F.lit(1), 5, 6)


def test_masks(spark):
    row = spark.createDataFrame([(float("nan"), float("inf"), 0.0, -1.0)], "n double, i double, z double, m double")
    out = one(row.select(masks.present(F.col("n")), masks.present(F.col("i")), masks.present(F.col("z")), masks.non_negative(F.col("z")), masks.non_negative(F.col("m")), masks.positive(F.col("z")), masks.log_of(F.col("m")), masks.wet(F.col("z"), F.col("m")), masks.any_present(F.lit(None), F.col("z"))))
    assert tuple(out) == (None, None, 0.0, 0.0, None, None, None, None, "available")
    assert masks.scale_name("X", 10.0) == "X_10KM" and masks.scale_name("X", 2.5) == "X_2.5KM"


def test_checks(spark):
    times = lambda *x: spark.createDataFrame([(v,) for v in x], "ts string").select(F.to_timestamp("ts").alias("ts"))
    quality.require_times(times("2024-07-01 00:00:00", "2024-07-01 12:00:00"), "2024-07-01", 2)
    for bad in (times("2024-07-01 00:00:00", "2024-07-01 00:00:00"), times("2024-07-02 00:00:00"), times(), times("2024-07-01 00:00:00")):
        with pytest.raises(quality.CheckError):
            quality.require_times(bad, "2024-07-01", 2)
    quality.require_hours(times(*(f"2024-07-01 {h:02}:00:00" for h in range(0, 24, 3))))
    with pytest.raises(quality.CheckError):
        quality.require_hours(times("2024-07-01 01:00:00"))
    attributes = {("NC_GLOBAL", "time_coverage_start"): "2020-01-01", ("NC_GLOBAL", "time_coverage_end"): "2021-01-01", ("sst", "units"): "K"}
    with pytest.raises(quality.CheckError):
        quality.require_covered(attributes, "2024-07-01")
    quality.require_covered(attributes, "2020-05-05")
    with pytest.raises(quality.CheckError):
        quality.require_units(attributes, "sst", "degree_C")
    for bad in (("2024-02-01", "2024-01-01", None), ("2024-01-01", "2024-02-01", 31)):
        with pytest.raises(quality.CheckError):
            quality.require_interval(*bad)
    axis = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 2.5)], "i int, lat double").withColumn("k", F.lit(1))
    assert [r.i for r in quality.falling(axis, ["k"], "i", "lat").collect()] == [2]
    with pytest.raises(quality.CheckError):
        quality.require_unique(axis, ["k"])


def test_rosters(spark):
    roster = spark.createDataFrame([("a",), ("b",)], "station string")
    inventory = spark.createDataFrame([("a", 1.0)], "station string, v double")
    assert {r.station: r.v for r in rosters.roster_values(roster, inventory, ["station"]).collect()} == {"a": 1.0, "b": None}
    with pytest.raises(quality.CheckError):
        rosters.require_inventory(roster, inventory, ["station"])
    with pytest.raises(quality.CheckError):
        rosters.roster_values(roster, inventory.union(inventory), ["station"])
    assert {r.v for r in rosters.lookup(roster, inventory, "station", "v", 0.5).collect()} == {1.0, 0.5}
    both = rosters.bag_union([roster, inventory], "kind", ["r", "i"])
    assert both.count() == 3 and both.where("kind = 'r' and v is null").count() == 2


def test_water_distances_without_a_cap_on_edges(spark, monkeypatch):
    import random

    from pelagia.operators import water

    monkeypatch.setattr(water, "MAX_EDGES", 3, raising=False)
    rng = random.Random(4)
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.25] + [(20, 21, 1.0)]
    starts = [(1, 0, 0.5), (2, 3, None), (3, 20, 9.0), (4, 99, 1.0)]
    for cutoff in (None, 8.0):
        want = {}
        for seed, cell, first in starts:
            best = {cell: first or 0.0}
            for _ in range(30):
                for a, b, km in edges:
                    for x, y in ((a, b), (b, a)):
                        if x in best and best[x] + km < best.get(y, 1e9) and (cutoff is None or best[x] + km <= cutoff):
                            best[y] = best[x] + km
            want |= {(seed, c): d for c, d in best.items()}
        got = water.water_distances(spark.createDataFrame(edges, "a long, b long, km double"), spark.createDataFrame(starts, "seed long, cell long, connector_km double"), cutoff_km=cutoff).collect()
        assert {(r.seed, r.cell): r.distance for r in got} == want and len(got) == len(want)
