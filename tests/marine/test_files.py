"""Sources, configuration, sinks, streaming, families and the entry module."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from pathlib import Path

import pytest
from pelagia.operators import quality
from pelagia.plans import families
from pelagia.sinks import store, tables
from pelagia.sources import cache, config, readers
from pelagia.streaming import live
from pydantic import ValidationError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_cache(tmp_path, spark):
    asked = []
    c = cache.RequestCache(tmp_path, get=lambda u: asked.append(u) or b'{"a": 1}')
    assert c.json("http://x/y", {"q": "1 2"}) == {"a": 1} and c.json("http://x/y", {"q": "1 2"}) == {"a": 1} and len(asked) == 1
    off = cache.RequestCache(tmp_path, offline=True)
    assert off.json("http://x/y", {"q": "1 2"}) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        off.get("http://x/other")
    assert cache.verified_files(spark, str(tmp_path)).select("url").first().url.startswith("http://x/y?q=")
    off.get("http://x/y", {"q": "1 2"}).write_bytes(b'{"a": 2}')
    with pytest.raises(ValueError):
        off.get("http://x/y", {"q": "1 2"})
    with pytest.raises(PySparkException):
        cache.verified_files(spark, str(tmp_path)).select(F.length("content")).collect()
    with pytest.raises(ValueError):
        cache.RequestCache(tmp_path, get=lambda u: b"<html>").get("http://x/z.nc", suffix=".nc")
    with pytest.raises(ValueError):
        cache.write_json(tmp_path / "m.json", {"x": float("nan")})


def test_pages(tmp_path, spark):
    page = lambda k, to: json.dumps({"features": [{"properties": {"id": str(k)}, "geometry": {"type": "Point", "coordinates": [-123.0, 48.0]}}], "links": [{"rel": "next", "href": to}] if to else []}).encode()
    served = {"http://f/1": page(1, "http://f/2"), "http://f/2": page(2, None), "http://g/1": page(1, "http://g/1")}
    c = cache.RequestCache(tmp_path, get=served.__getitem__)
    rows = readers.features(spark, [str(p) for p in c.pages("http://f/1")]).collect()
    assert sorted((r.properties["id"], r.lon, r.lat) for r in rows) == [("1", -123.0, 48.0), ("2", -123.0, 48.0)]
    with pytest.raises(ValueError):
        c.pages("http://g/1")


def test_erddap_and_grid_source(tmp_path, spark):
    info = {"table": {"columnNames": ["Row Type", "Variable Name", "Attribute Name", "Data Type", "Value"], "rows": [["attribute", "sst", "units", "String", "degree_C"], ["variable", "sst", "", "float", ""]]}}
    assert readers.erddap_attributes(info) == {("sst", "units"): "degree_C"}
    assert readers.griddap_query("sst", "2024-07-01", (-125, 46, -121, 50), quality="q").startswith("sst[(2024-07-01T12:00:00Z)][(50):(46)][(-125):(-121)],q")
    rows = [["2024-07-01T00:00:00Z", 48.0, -123.0, 10.0], ["2024-07-01T01:00:00Z", 48.0, -123.0, 11.0], ["2024-07-01T02:00:00Z", 60.0, -123.0, 1.0], ["2024-07-01T02:00:00Z", 48.5, -123.0, None]]
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"table": {"columnNames": ["time", "latitude", "longitude", "sst"], "rows": rows}}))
    spark.dataSource.register(readers.GridSource)
    got = spark.read.format("marine_grid").option("path", str(path)).option("variables", "sst").option("north", "50").option("step", "2").load().collect()
    assert [(r.lat, r.sst) for r in got] == [(48.0, 10.0), (48.5, None)]


def test_archive_and_span():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("d/mesh.nod", "1 2 3")
        z.comment = b"note"
    assert readers.embedded_zip(b"MZ stub" + held.getvalue() + b"trailer", "mesh.nod") == b"1 2 3"
    for bad in (b"not an archive", b"PK\x05\x06" + b"\0" * 18):
        with pytest.raises(ValueError):
            readers.embedded_zip(bad, "mesh.nod")
    xml = "<d><TimeSpan><begin>2020-01-01T00:00:00Z</begin><end>2021-01-01T00:00:00Z</end></TimeSpan></d>"
    readers.require_span(xml, "2020-06-01")
    with pytest.raises(ValueError):
        readers.require_span(xml, "2022-06-01")


def test_mesh_files(tmp_path, spark):
    (tmp_path / "n").write_text("1 -123.0 48.0\n2 -122.0 48.0\n3 -123.0 49.0\n")
    (tmp_path / "e").write_text("1 1 2 3\n")
    (tmp_path / "h").write_text("M2 amplitudes\n0\n1 2.0 90.0\n2 1.0 0.0\n3 1.0 180.0\n")
    assert readers.require_sequence(readers.mesh_nodes(spark, str(tmp_path / "n")), "node").count() == 3
    assert tuple(readers.mesh_elements(spark, str(tmp_path / "e")).first()) == (1, 1, 2, 3)
    h = {r.node: (round(r.re, 9), round(r.im, 9)) for r in readers.constituent(spark, str(tmp_path / "h"), "M2").collect()}
    assert h == {1: (0.0, -2.0), 2: (1.0, 0.0), 3: (-1.0, 0.0)}
    with pytest.raises(ValueError):
        readers.require_sequence(spark.createDataFrame([(1,), (3,)], "node int"), "node")


def test_config(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("current_interval_hours: 4\ntide_decay_km: [20, 40]\nriver_decay_km: [10]\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\ncurrent_interval_hours: 6\ntide_decay_km: [5]\nraw_dir: ${env:RAW}\nfeature_dir: ${raw_dir}\n")
    monkeypatch.setenv("RAW", "data/here")
    document, settings = config.load(tmp_path / "own.yaml")
    assert (settings.current_interval_hours, settings.tide_decay_km, settings.raw_dir, settings.feature_dir) == (6, [5], "data/here", "data/here")
    assert settings.bbox.west == -125.80
    for bad in ({"unknown": 1}, {"raw_dir": "../elsewhere"}, {"tide_decay_km": [5, 5]}, {"tide_decay_km": [101]}, {"current_interval_hours": 5}, {"min_tide_samples": 900}, {"seed_snap_max_km": 11}, {"kernel_cutoff_multiples": 6}, {"seed_shore_tolerance_m": 201},
                {"mouth_coast_snap_max_m": 1501}, {"tide_coast_snap_max_m": 301}, {"productivity_window_days": 8}, {"productivity_min_valid_days": 8}, {"tides": [{"provider": "X", "station": "1"}]}, {"rivers": [{"provider": "USGS", "station": "1"}]}):
        with pytest.raises(ValidationError):
            config.Settings(**bad)
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    with pytest.raises(ValueError):
        config.read(tmp_path / "loop.yaml")
    assert config.fingerprint({"a": 1, "api_key": "x"}) == config.fingerprint({"api_key": "y", "a": 1}) != config.fingerprint({"a": 2, "api_key": "x"})
    assert config.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_workspace(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("mine")
    assert [p.name for p in config.initialize(tmp_path, {"a.yaml": "new", "d/b.yaml": "new"})] == ["b.yaml"]
    assert (tmp_path / "a.yaml").read_text() == "mine"
    monkeypatch.setenv("PELAGIA_WORKSPACE", str(tmp_path))
    assert config.workspace() == tmp_path.resolve()


def test_feature_tables(tmp_path, spark):
    rows = spark.createDataFrame([("c2", 1.0, 2.0), ("c1", None, 3.0)], "H3_INDEX string, SST_MEAN_C double, area double")
    path = str(tmp_path / "features")
    for day in ("2024-07-01", "2024-07-02"):
        out = tables.decorate(rows, "ocean_temperature", day, 6, tables.metric_columns(rows, ("SST_",)))
        tables.write_features(out, path)
    tables.write_features(tables.decorate(rows.limit(1), "ocean_temperature", "2024-07-02", 6, ["SST_MEAN_C"]), path)
    got, gone = readers.partitions(spark, path, "ocean_temperature", "2024-06-30", "2024-07-02")
    assert gone == ["2024-06-30"] and got.where("DATE = '2024-07-01'").count() == 2 and got.where("DATE = '2024-07-02'").count() == 1
    assert {r.H3_INDEX: r.FEATURE_STATUS for r in got.where("DATE = '2024-07-01'").collect()} == {"c1": "unavailable", "c2": "available"}
    told = tables.write_manifest(str(tmp_path / "m.json"), rows, ["SST_MEAN_C"], "area", config_sha256="x")
    assert json.loads((tmp_path / "m.json").read_text()) == told and told["coverage"][0]["valid_area_fraction"] == 0.4
    files = sorted(Path(path).rglob("*.parquet"))
    assert tables.digest(files) == tables.digest(files[::-1]) and len(tables.digest(files)) == 64
    page = rows.select(F.concat(F.lit("</script>"), "H3_INDEX").alias("cell"), F.lit("2024-07-01").alias("day"), "SST_MEAN_C")
    page = page.unionByName(page.withColumn("day", F.lit("2024-07-02")).withColumn("SST_MEAN_C", F.col("SST_MEAN_C") * 5)).withColumns({"lat": F.lit(48.5), "lon": F.lit(-123.5)})
    assert tables.report(page, str(tmp_path / "pages"), "a <b>", ["SST_MEAN_C"]) == 2
    index = (tmp_path / "pages/a <b>.html").read_text()
    assert "a &lt;b&gt;" in index and index.count("<li>") == 2
    for day in ("2024-07-01", "2024-07-02"):
        text = (tmp_path / f"pages/a <b>-{day}.html").read_text()
        assert f"a &lt;b&gt;, {day}" in text and text.count("</script>") == 1 and '"ranges": {"SST_MEAN_C": [1.0, 5.0]}' in text and '"SST_MEAN_C": null' in text


def test_store(spark, tmp_path):
    path = f"{tmp_path}/deep/er/a.json"
    assert not store.exists(spark, path)
    for value in ({"b": 1, "a": ["é"]}, {"b": 2}):
        store.write_json(spark, path, value)
        assert store.exists(spark, path) and store.read_json(spark, path) == value
    assert [p.name for p in Path(path).parent.iterdir()] == ["a.json"]
    with pytest.raises(ValueError):
        store.write_json(spark, path, float("nan"))
    many = spark.range(2000).selectExpr("id", "repeat('x', 2000) || id v").repartition(5)
    many.write.parquet(f"{tmp_path}/rows")
    told = store.folder_digest(spark, f"{tmp_path}/rows")
    assert told == store.folder_digest(spark, f"{tmp_path}/rows")
    part = next(Path(f"{tmp_path}/rows").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"?")
    assert told != store.folder_digest(spark, f"{tmp_path}/rows")


def test_a_large_day_is_several_files(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("format_string('c%06d', id) H3_INDEX", "rand(1) SST_MEAN_C", "double(1) area")
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "300k")
    try:
        tables.write_features(tables.decorate(rows, "ocean_temperature", "2024-07-01", 6, ["SST_MEAN_C"]), str(tmp_path / "f"))
    finally:
        for n, value in zip(names, old, strict=True):
            spark.conf.set(n, value)
    files = sorted((tmp_path / "f").rglob("*.parquet"))
    assert len(files) > 1
    ends = sorted((r.a, r.b) for f in files for r in spark.read.parquet(str(f)).selectExpr("min(H3_INDEX) a", "max(H3_INDEX) b").collect())
    assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:], strict=False)) and spark.read.parquet(str(tmp_path / "f")).count() == 60_000


def test_rest_of_feature_tables(spark):
    rows = spark.createDataFrame([("c2", 1.0, 2.0)], "H3_INDEX string, SST_MEAN_C double, area double")
    assert tables.catalog(rows, {"area": "m2"})[2] == {"name": "area", "type": "double", "description": "m2"}


def test_families(spark):
    index = lambda lat, lon: F.floor(lat).cast("long")
    support = spark.createDataFrame([(48, 1.0), (49, 1.0)], "cell long, area double")
    px = spark.createDataFrame([(48.5, -123.0, 10.0, 5, 2.0), (48.6, -123.0, 50.0, 5, 0.0), (48.7, -123.0, 12.0, 1, 8.0)], "lat double, lon double, sst double, quality int, chlorophyll double")
    sst = {r.cell: r for r in families.ocean_temperature(px, support, index).collect()}
    assert sst[48].SST_MEAN_C == 10 and sst[48].input_pixel_count == 3 and sst[49].SST_MEAN_C is None
    chl = {r.cell: r for r in families.productivity(px, support, index).collect()}
    assert chl[48].CHLOROPHYLL_MEAN_MG_M3_valid_pixels == 2 and chl[48].CHLOROPHYLL_LOG_MEAN == pytest.approx((0.693147 + 2.079442) / 2, abs=1e-2)
    flow = spark.createDataFrame([(t, y, x, 48.5, -123.0 + x, 3.0, 4.0, 9.0) for t in range(6) for y in range(2) for x in range(2)], "t int, y int, x int, lat double, lon double, u double, v double, depth double")
    assert {r.cell: r.CURRENT_SPEED_SAMPLE_MEAN_MS for r in families.currents(flow, support, index).collect()} == {48: 5.0, 49: None}
    sea = spark.createDataFrame([(t, 0, 0, 48.5, 237.0, 3.0, 4.0) for t in range(8)], "t int, y int, x int, lat double, lon double, u double, v double")
    assert families.offshore_currents(sea, support, index).where("cell = 48").first().OFFSHORE_CURRENT_SPEED_SAMPLE_MAX_MEAN_MS == 5
    fine = spark.createDataFrame([(480, 1.0), (481, 1.0), (490, 1.0)], "cell long, area double")
    near = spark.createDataFrame([("r", 480, 0.0), ("r", 481, 1.0)], "seed string, cell long, distance double")
    out = families.influence_features(fine, support, near, spark.createDataFrame([("r", 8.0)], "seed string, value double"), "RIVER", [10.0], lambda c: F.floor(c / 10))
    got = {r.cell: r for r in out.collect()}
    assert got[48].RIVER_10KM == pytest.approx(8 * (1 + 2.718281828 ** -0.1) / 2) and got[49].RIVER_10KM is None and got[49].MEAN_EXPECTED_SOURCES_10KM == 0
    assert families.days_of("productivity", "2024-07-07", "2024-07-08") == [f"2024-07-0{k}" for k in range(1, 9)] and families.days_of("tides", "2024-07-07", "2024-07-07") == ["2024-07-07"]

    def broken():
        raise ValueError("no data")

    rows, why = families.contained(broken, support, {"SST_MEAN_C": "double"})
    assert why == "no data" and rows.where("SST_MEAN_C is null").count() == 2


def test_streams(tmp_path, spark):
    rows = spark.createDataFrame([("a", f"2024-07-01 0{h}:{m}:00", float(h * 10 + m)) for h in range(4) for m in (10, 20)], "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    live.daily_partitions(live.hourly(stream, ["k"], "v", late="0 seconds"), lambda df, k: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.hour.hour: (r.samples, r.value_range) for r in seen} == {h: (2, 10.0) for h in range(3)}  # the last hour is still open


def test_status(spark):
    rows = spark.createDataFrame([("a", False, 0), ("b", False, 2), ("c", True, 0), ("c", False, 1)], "k string, failed boolean, errors int")
    assert {r.k: r.status for r in quality.status(rows, ["k"]).collect()} == {"a": "available", "b": "partial", "c": "unavailable"}
    want, have = spark.createDataFrame([("x",), ("y",)], "d string"), spark.createDataFrame([("x",)], "d string")
    assert [r.d for r in quality.missing(want, have, ["d"]).collect()] == ["y"]


def test_entry(spark):
    import __spark_entry__ as e

    from pelagia.plans import queries

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["p_partkey", "input_pixel_count", "valid_pixels", "mean_x"]


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['pelagia.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q[:2] == 'op' or q == 'pipeline']; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert int(out.stdout) > 30, out.stderr


@pytest.mark.parametrize("name", sorted(__import__("pelagia.plans.queries", fromlist=["x"]).QUERIES))
def test_oracle(spark, name):
    """Each query against DuckDB on the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    from pelagia.plans import queries

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {table} as select * from read_parquet('{d}/{table}.parquet')")
    got = queries.QUERIES[name](spark, d)
    names = sorted(got.columns)
    sql = con.execute(f"select {', '.join(f'"{c}"' for c in names)} from ({queries.ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(sql, key=key)


def test_digest_of_requests():
    assert hashlib.sha256(cache.canonical("http://x", {"b": "1"}).encode()).hexdigest() == hashlib.sha256(b"http://x?b=1").hexdigest()
