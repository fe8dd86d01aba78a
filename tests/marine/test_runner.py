from __future__ import annotations

import json

import numpy as np
import pytest
from pelagia.functions import cells
from pelagia.operators import quality
from pelagia.plans import runner
from pelagia.sources import config
from pyspark.sql import functions as F

DAY = "2024-07-01"


def workspace(spark, root):
    """Two places; the second has no data."""
    assert runner.main(["init", "--workspace", str(root)]) == 0
    place = spark.createDataFrame([(48.5, -123.5), (20.0, 10.0)], "lat double, lon double")
    for res in (5, 6, 8):
        place.select(cells.hex_cell(F.col("lat"), F.col("lon"), res).alias("cell"), F.lit(2.0).alias("area"), F.lit(True).alias("has_water_overlap")).write.parquet(f"{root}/support/r{res}")
    fine = place.select(cells.hex_cell(F.col("lat"), F.col("lon"), 8).alias("cell"))
    for name in ("tide_distances", "river_distances"):
        fine.limit(1).select(F.lit("s1").alias("seed"), "cell", F.lit(0.0).alias("distance")).write.parquet(f"{root}/support/{name}")
    spark.createDataFrame([("s1", "G1"), ("s2", "G2")], "seed string, gauge string").write.parquet(f"{root}/support/gauges")
    place.select(cells.hex_cell(F.col("lat"), F.col("lon"), 6).alias("cell"), "lat", "lon").write.parquet(f"{root}/support/points")
    spark.createDataFrame([("s1", 48.4, -123.5), ("far", 10.0, 10.0), ("dry", 48.3, -123.4)], "seed string, lat double, lon double").write.parquet(f"{root}/support/tide_stations")
    spark.createDataFrame([(1, -124.0, 48.0), (2, -123.0, 48.0), (3, -123.5, 49.0)], "node int, lon double, lat double").write.parquet(f"{root}/support/mesh_nodes")
    spark.createDataFrame([(1, 1, 2, 3)], "tri int, n0 int, n1 int, n2 int").write.parquet(f"{root}/support/mesh_elements")
    spark.createDataFrame([(k, "S2", 1.0, 0.0) for k in (1, 2, 3)], "node int, constituent string, re double, im double").write.parquet(f"{root}/support/constituents")
    document, settings = config.load(root / "pelagia.yaml")
    told = (config.fingerprint(document), settings.bbox.model_dump())

    def publish(family, rows, schema, day=DAY, errors=None):
        runner.publish_layer(spark.createDataFrame(rows, schema), f"{root}/layers", family, day, *told, errors)

    publish("ocean_temperature", [(48.5, -123.5, 11.0, 5)], "lat double, lon double, sst double, quality int")
    for day, x in (("2024-06-26", 2.0), (DAY, 4.0)):
        publish("productivity", [(48.5, -123.5, x)], "lat double, lon double, chlorophyll double", day)
    publish("currents", [(t, y, x, 48.5, -123.5, 3.0, 4.0, 9.0) for t in range(6) for y in range(2) for x in range(2)], "t int, y int, x int, lat double, lon double, u double, v double, depth double", errors=["one file late"])
    publish("offshore_currents", [(t, 0, 0, 48.5, 236.5, 3.0, 4.0) for t in range(8)], "t int, y int, x int, lat double, lon double, u double, v double")
    hours = [("s1", f"{DAY} {h:02d}:00:00", float(h)) for h in range(24)] + [("s1", "2024-07-02 00:00:00", 99.0)]
    runner.publish_layer(spark.createDataFrame(hours, "seed string, ts string, value double").withColumn("ts", F.to_timestamp("ts")), f"{root}/layers", "tides", DAY, *told)
    publish("river_discharge", [("s1", "G1", DAY, "100", "ft^3/s")], "seed string, station string, day string, value string, unit string")

    return publish


def test_build_compare_inspect(spark, tmp_path):
    publish = workspace(spark, tmp_path)
    asked = ["--workspace", str(tmp_path), "--start", DAY, "--end", DAY, "--cells", "h3"]
    assert runner.main(["build", *asked]) == 1  # look-back days without layers are there, but unavailable
    out = f"{tmp_path}/data/features"
    told = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "data/features/manifests").iterdir()}
    status = {f: told[f"{f}-{DAY}"]["status"] for f in runner.FAMILIES}
    assert status == {**dict.fromkeys(runner.FAMILIES, "available"), "currents": "partial"}, [m["error"] for m in told.values() if m.get("error")]
    assert told[f"currents-{DAY}"]["source_errors"] == ["one file late"] and len(told[f"currents-{DAY}"]["code_sha256"]) == 64
    assert told["productivity-2024-06-27"]["status"] == "unavailable" and "no layer" in told["productivity-2024-06-27"]["error"]
    assert told[f"productivity_with_composites-{DAY}"]["missing_days"] == ["2024-06-25", "2024-06-27", "2024-06-28", "2024-06-29", "2024-06-30"]

    def values(family, column):
        return {round(r[0], 6) if isinstance(r[0], float) else r[0] for r in spark.read.parquet(f"{out}/{family}").where(F.col("DATE") == DAY).select(column).collect()}

    assert values("ocean_temperature", "SST_MEAN_C") == {11.0, None} and values("ocean_temperature", "FEATURE_STATUS") == {"available", "unavailable"}
    assert values("tides", "TIDE_RANGE_PROXY_M_20KM") == {23.0, None} and values("tides", "MEAN_EXPECTED_SOURCES_40KM") == {1.0, 0.0}
    assert values("river_discharge", "RIVER_DISCHARGE_INFLUENCE_M3_S_10KM") == {2.831685, None}
    assert values("tidal_model", "HARMONIC_TIDE_HOURLY_RANGE_M") == {2.004316, None}  # twice the nodal factor of S2 on that day
    assert values("tidal_model", "NATIVE_TRIANGLE") == {1, -1}
    chl = spark.read.parquet(f"{out}/productivity_with_composites").where("COMPOSITE_VALID_DAYS > 0").collect()
    assert {(str(r.DATE), r.CHLOROPHYLL_TRAILING_7D_MEAN_MG_M3, r.COMPOSITE_OLDEST_AGE_DAYS) for r in chl} == {(DAY, 3.0, 5)}
    rivers = spark.read.parquet(f"{out}/stations/river_discharge/DATE={DAY}").collect()
    assert sorted((r.seed, r.DISCHARGE_M3_S is None) for r in rivers) == [("s1", False), ("s2", True)]

    assert runner.main(["compare", *asked]) == 0
    found = json.loads((tmp_path / "comparison.json").read_text())
    assert found["currents"][0]["mae"] == 0.0 and found["tidal_model"][0]["cells"] == 1 and found["automatic_blending"] is False
    assert [(r["family"], r["DATE"], r["original_fraction"], r["broader_fraction"], r["either_fraction"]) for r in found["coverage"]] == [("currents", DAY, 0.5, 0.5, 0.5), ("tides", DAY, 0.5, 0.5, 0.5)]
    checks = {r["station"]: r for r in found["tide_checks"]}
    assert checks["s1"]["status"] == "compared" and checks["s1"]["n"] == 24 and checks["s1"]["range_error"] == pytest.approx(2.004316 - 23, abs=1e-6)
    assert checks["far"]["status"] == "outside_or_ambiguous_native_mesh" and checks["far"]["mae"] is None and checks["dry"]["status"] == "reference_incomplete"
    assert runner.main(["inspect", *asked, "--families", "ocean_temperature"]) == 0 and (tmp_path / "ocean_temperature.html").exists()

    # Another area, repeated places, and features that are not what was published.
    publish("currents", [(0, 0, 0, 48.5, -123.5, 3.0, 4.0, 9.0)] * 2, "t int, y int, x int, lat double, lon double, u double, v double, depth double")
    publish("river_discharge", [("s1", "G1", DAY, "100", "furlong")], "seed string, station string, day string, value string, unit string")
    path = tmp_path / f"layers/manifests/tides-{DAY}.json"
    path.write_text(path.read_text().replace("-125.8", "-125.9"))
    assert runner.main(["build", *asked, "--families", "tides", "currents", "river_discharge"]) == 1
    errors = {f: json.loads((tmp_path / f"data/features/manifests/{f}-{DAY}.json").read_text())["error"] for f in ("tides", "currents", "river_discharge")}
    assert "another area" in errors["tides"] and "repeated" in errors["currents"] and "unknown unit" in errors["river_discharge"]
    assert values("river_discharge", "RIVER_DISCHARGE_INFLUENCE_M3_S_10KM") == {None}
    next((tmp_path / f"data/features/ocean_temperature/family=ocean_temperature/DATE={DAY}").glob("*.parquet")).unlink()
    with pytest.raises(quality.CheckError):
        runner.main(["inspect", *asked, "--families", "ocean_temperature"])
    with pytest.raises(quality.CheckError):
        runner.build(spark, "x", runner.Region({}), "y", DAY, DAY, ("waves",))
    with pytest.raises(quality.CheckError):
        runner.compare(spark, f"{tmp_path}/none", DAY, DAY)


def test_compare_currents(spark):
    place = spark.createDataFrame([(48.5, -123.5)], "lat double, lon double")
    fine = place.select(cells.grid_cell(F.col("lat"), F.col("lon"), 6).alias("cell"), F.lit("2024-07-01").alias("DATE"), F.lit(2.0).alias("area"), F.lit(0.5).alias("a"))
    coarse = place.select(cells.grid_cell(F.col("lat"), F.col("lon"), 5).alias("cell"), F.lit("2024-07-01").alias("DATE"), F.lit(0.75).alias("b"))
    r = runner.compare_currents(fine, coarse, "a", "b").first()
    assert (r.n, r.mae, r.mean_observed) == (1, 0.25, 0.5)


def test_compare_tides(spark):
    rows = [(s, d, h, float(h % 6), float(h % 6) + 1) for s in ("a", "b", "c") for d in ("d1", "d2") for h in range(24) if (s, d, h) != ("b", "d2", 5)]
    both = spark.createDataFrame(rows, "station string, DATE string, hour int, value double, height double")
    at = spark.createDataFrame([(s, d, t) for s, t in (("a", 4), ("b", 4), ("c", -1), ("d", 7)) for d in ("d1", "d2")], "station string, DATE string, triangle int")
    got = {(r.station, r.DATE): r for r in runner.compare_tides(both.drop("height"), both.drop("value"), at).collect()}
    for d in ("d1", "d2"):
        assert (got["a", d].status, got["a", d].n, got["a", d].mae, round(got["a", d].correlation, 9)) == ("compared", 24, 1.0, 1.0)
    assert [got["b", d].status for d in ("d1", "d2")] == ["compared", "reference_incomplete"] and got["b", "d2"].n is None
    assert [got[k, "d1"].status for k in "cd"] == ["outside_or_ambiguous_native_mesh", "reference_incomplete"]


def test_coverage_day_by_day(spark):
    """A day on which the broader source has no value is not covered by its other days."""
    place = spark.createDataFrame([(48.5, -123.5), (20.0, 10.0)], "lat double, lon double")
    fine = place.select(cells.hex_cell(F.col("lat"), F.col("lon"), 6).alias("cell"), "lat").crossJoin(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "DATE string"))
    fine = fine.withColumns({"area": F.when(F.col("lat") > 40, 1.0).otherwise(3.0), "a": F.when((F.col("lat") > 40) & (F.col("DATE") == "d2"), 1.0)})
    coarse = place.select(cells.hex_cell(F.col("lat"), F.col("lon"), 5).alias("cell"), "lat").crossJoin(spark.createDataFrame([("d1",), ("d2",)], "DATE string"))
    coarse = coarse.withColumn("b", F.when((F.col("lat") < 40) & (F.col("DATE") == "d1"), 2.0))
    got = {r.DATE: (r.original_fraction, r.broader_fraction, r.either_fraction) for r in runner.source_coverage(fine, coarse, "a", "b", 6, 5).collect()}
    assert got == {"d1": (0.0, 0.75, 0.75), "d2": (0.25, 0.0, 0.25), "d3": (0.0, 0.0, 0.0)}


def test_distances_in_build(spark, tmp_path):
    """Seeds to distances: a station on the water, a mouth a little inland, one too far, one whose connector crosses land."""
    from pelagia.functions import geometry as g

    lon = [-123.50 + 0.02 * k for k in range(8)]
    rows = spark.createDataFrame([(48.5, x, k != 7, 0 if k == 6 else 2, "terminal_connector" if k == 7 else "graph") for k, x in enumerate(lon)], "lat double, lon double, eligible boolean, degree int, connection string")
    support = rows.withColumn("cell", cells.hex_cell(F.col("lat"), F.col("lon"), 8)).orderBy("lon")
    ids = [r.cell for r in support.collect()]
    assert len(set(ids)) == 8
    support = support.withColumns({"area": F.lit(1.0), "connector_target": F.when(F.col("connection") == "terminal_connector", F.lit(ids[5])), "connector_m": F.when(F.col("connection") == "terminal_connector", 250.0)})
    edges = spark.createDataFrame([(ids[k], ids[k + 1], 600.0, k != 3) for k in range(6)] + [(ids[1], ids[0], 500.0, True), (ids[2], ids[4], 900.0, True)], "source long, target long, distance_m double, passable boolean")
    water = np.array([[-123.6, 48.4], [-123.3, 48.4], [-123.3, 48.6], [-123.6, 48.6], [-123.6, 48.4]])
    seeds = [("tide", "tide", 48.501, lon[0]), ("mouth", "river_mouth", 48.5, -123.606), ("far", "tide", 48.5, -123.606), ("none", "tide", 46.9, -125.0)]
    fixed = {"seeds": spark.createDataFrame(seeds, "seed string, kind string, lat double, lon double"), "water": spark.createDataFrame([(bytearray(g.to_wkb([water])),)], "wkb binary"), "edges": edges}
    region = runner.with_distances(spark, runner.Region({8: support}, fixed), str(tmp_path))
    status = {r.seed: (r.status, r.cell) for r in spark.read.parquet(f"{tmp_path}/distances/mapping").collect()}
    assert status == {"tide": ("mapped", ids[0]), "mouth": ("mapped", ids[0]), "far": ("unmapped", None), "none": ("unmapped", None)}
    way = {r.cell: r.distance for r in region.fixed["tide_distances"].collect()}
    start = way[ids[0]]
    assert 0.1 < start < 0.12 and {ids.index(c): round(d - start, 6) for c, d in way.items()} == {0: 0.0, 1: 0.5, 2: 1.1, 3: 1.7, 4: 2.0, 5: 2.6, 6: 3.2, 7: 2.85}
    assert {r.seed for r in region.fixed["river_distances"].collect()} == {"mouth"}
    assert runner.with_distances(spark, region, "nowhere") is region
