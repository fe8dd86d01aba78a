"""Collection from a server of our own: what is asked for, what comes back, and what fails."""

from __future__ import annotations

import json
import re
import threading
import urllib.parse
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import numpy as np
import pytest
from pelagia.plans import collect, runner
from pelagia.sources import config, netcdf
from pyspark.sql import functions as F
from test_netcdf import written

DAY = "2024-07-01"
LAT, LON = np.arange(51.0, 45.9, -0.25), np.arange(-127.0, -120.9, 0.25)


class Server(BaseHTTPRequestHandler):
    asked: list[str] = []
    folder = ""

    def log_message(self, *args) -> None:
        pass

    def do_GET(self) -> None:
        path, _, query = self.path.partition("?")
        query = urllib.parse.unquote(query)
        Server.asked.append(f"{path}?{query}")
        try:
            body = self.body(path, query)
        except KeyError:
            self.send_error(404)
            return
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def body(self, path: str, query: str) -> bytes:
        told = lambda x: json.dumps(x).encode()
        if path.startswith("/erddap/info/"):
            name = path.split("/")[3]
            units = {"sst": ("sea_temp", "degree_C"), "u": ("uVelocity", "m s-1"), "v": ("vVelocity", "m s-1"), "geo": ("bathymetry", "m")}[name]
            rows = [["attribute", "NC_GLOBAL", "time_coverage_start", "String", "2020-01-01T00:00:00Z"], ["attribute", "NC_GLOBAL", "time_coverage_end", "String", "2024-07-10T00:00:00Z"],
                    ["attribute", units[0], "units", "String", units[1]], ["attribute", "latitude", "actual_range", "double", "51.0, 46.0"], ["attribute", "longitude", "actual_range", "double", "-127.0, -121.0"]]
            return told({"table": {"columnNames": ["Row Type", "Variable Name", "Attribute Name", "Data Type", "Value"], "rows": rows}})
        if path.startswith("/erddap/griddap/"):
            return self.grid(path.split("/")[3].removesuffix(".nc"), query)
        if path == "/hycom/2024/dataset.xml":
            return b"<gridDataset><TimeSpan><begin>2024-01-01T00:00:00Z</begin><end>2024-12-31T21:00:00Z</end></TimeSpan></gridDataset>"
        if path == "/hycom/2024":
            q = dict(urllib.parse.parse_qsl(query))
            assert q["accept"] == "netcdf" and q["time_start"] == f"{DAY}T00:00:00Z"
            dims = ["time", "depth", "lat", "lon"]
            return self.file({"time": 8, "depth": 1, "lat": 2, "lon": 2}, {"time": (["time"], np.arange(8) * 3.0, {"units": f"hours since {DAY}"}), "depth": (["depth"], np.zeros(1), {}), "lat": (["lat"], np.array([48.0, 49.0]), {}), "lon": (["lon"], np.array([234.0, 235.0]), {}),
                              "water_u": (dims, np.full((8, 1, 2, 2), 3000, np.int16), {"units": "m/s", "scale_factor": 0.001}), "water_v": (dims, np.full((8, 1, 2, 2), 4000, np.int16), {"units": "m/s", "scale_factor": 0.001})})
        if path == "/chs/stations":
            return told([{"id": "x1", "code": "07120", "latitude": 48.4, "longitude": -123.4, "officialName": "A"}, {"id": "x2", "code": "07999", "latitude": 49.0, "longitude": -123.0, "officialName": "B"}])
        if path == "/chs/stations/x1/data":
            return told([{"eventDate": f"{DAY}T{h:02d}:00:00Z", "value": h / 2} for h in range(24)])
        if path == "/chs/stations/x2/data":
            return told({"message": "no series"})
        if path == "/noaa/mdapi/prod/webapi/stations.json":
            return told({"stations": [{"id": "9449880", "lat": 48.5, "lng": -123.0, "name": "C"}]})
        if path == "/noaa/api/prod/datagetter":
            return told({"predictions": [{"t": f"{DAY} {h:02d}:00", "v": str(h)} for h in range(24)]})
        if path == "/eccc/collections/hydrometric-daily-mean/items":
            page = "offset=1" in query
            links = [] if page else [{"rel": "next", "href": f"http://127.0.0.1:{self.server.server_port}{path}?offset=1"}]
            return told({"features": [{"properties": {"STATION_NUMBER": "08MF005", "DATE": f"{DAY}", "DISCHARGE": 6000.0 + page}}], "links": links})
        if path == "/usgs/collections/daily/items":
            ok = "USGS-1" in query
            return told({"features": [{"properties": {"time": DAY, "value": "100", "unit_of_measure": "ft^3/s", "parameter_code": "00060", "statistic_id": "00003" if ok else "00001"}}]})
        raise KeyError(path)

    def grid(self, name: str, query: str) -> bytes:
        variables = query.split(",")
        parts = re.findall(r"\[([^\]]*)\]", variables[0])
        names = [v.split("[")[0] for v in variables]
        if name == "sst":
            day = parts[0][1:11]
            y, x = ([float(v) for v in re.findall(r"\(([-\d.]+)\)", p)] for p in parts[1:])
            assert y[0] > y[1] and x[0] < x[1]
            near = lambda axis, v: int(np.abs(axis - v).argmin())
            lat, lon = LAT[near(LAT, y[0]) : near(LAT, y[1]) + 1], LON[near(LON, x[0]) : near(LON, x[1]) + 1]
            dims = ["time", "latitude", "longitude"]
            data = {"sea_temp": (lat[:, None] + lon[None, :] / 1000)[None].astype(np.float32), "quality": np.full((1, len(lat), len(lon)), 5, np.int8)}
            return self.file({"time": 1, "latitude": len(lat), "longitude": len(lon)}, {"time": (["time"], np.array([43200.0]), {"units": f"seconds since {day}"}), "latitude": (["latitude"], lat, {}), "longitude": (["longitude"], lon, {}),
                              **{n: (dims, data[n], {"units": "degree_C"} if n == "sea_temp" else {}) for n in names}})
        dims, sizes = ["gridY", "gridX"], {"gridY": 3, "gridX": 4}
        axes = {d: ([d], np.arange(n, dtype=np.int16), {}) for d, n in sizes.items()}
        if name == "geo":
            return self.file(sizes, axes | {n: (dims, np.full((3, 4), {"latitude": 48.5, "longitude": -123.5, "bathymetry": 30.0}[n]), {}) for n in names})
        stride = int(parts[0].split("):")[1].split(":")[0])
        hours = np.arange(0, 24, stride) + 0.5
        assert parts[1] == "0" and parts[2] == "0:1:last"
        return self.file({"time": len(hours), "depth": 1} | sizes, axes | {"time": (["time"], hours, {"units": f"hours since {DAY}"}), "depth": (["depth"], np.array([0.5]), {}),
                                                                          names[0]: (["time", "depth", *dims], np.full((len(hours), 1, 3, 4), 3.0 if name == "u" else 4.0), {"units": "m s-1"})})

    def file(self, dims: dict, variables: dict) -> bytes:
        path = f"{Server.folder}/{threading.get_ident()}-{len(Server.asked)}.nc"
        return Path(written(path, dims, variables, 2, "time" if "time" in dims else None)).read_bytes()


@pytest.fixture(scope="module")
def server(tmp_path_factory):
    Server.folder = str(tmp_path_factory.mktemp("served"))
    own = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def settings(base: str) -> config.Settings:
    gauge = {"name": "n", "mouth_lon": -123.0, "mouth_lat": 49.0, "mouth_reference": "r", "mapping_status": "source_mouth"}
    return config.Settings(satellite_base=f"{base}/erddap", salish_base=f"{base}/erddap", current_u_dataset="u", current_v_dataset="v", current_geometry_dataset="geo", offshore_current_base=f"{base}/hycom",
                           chs_base=f"{base}/chs", noaa_base=f"{base}/noaa", eccc_base=f"{base}/eccc", usgs_base=f"{base}/usgs",
                           satellites={"ocean_temperature": {"dataset": "sst", "variable": "sea_temp", "units": "degree_C", "resolution": 6, "quality_variable": "quality"}, "productivity": {"dataset": "chl", "variable": "chl", "units": "mg", "resolution": 5}},
                           tides=[{"provider": "CHS", "station": "07120"}, {"provider": "CHS", "station": "07999"}, {"provider": "CHS", "station": "none"}, {"provider": "NOAA", "station": "9449880"}],
                           rivers=[{"provider": "ECCC", "station": "08MF005"} | gauge, {"provider": "USGS", "station": "USGS-1"} | gauge, {"provider": "USGS", "station": "USGS-2"} | gauge])


def test_limits_become_requests(spark, server, tmp_path):
    collect.prepare(spark)

    def grid(**limits):
        options = {"base": f"{server}/erddap", "dataset": "sst", "variables": "sea_temp", "cache": str(tmp_path), "units": "sea_temp=degree_C", "tile": "1"}
        return netcdf.limited(spark.read.format("marine_remote_grid").options(**options), **limits)

    Server.asked.clear()
    at = lambda text: datetime.fromisoformat(f"{text}:00+00:00")
    got = grid(time=(at("2024-07-02T00:00"), at("2024-07-03T23:00")), latitude=(47.1, 49.0), longitude=(-125.0, -124.0))
    rows = got.collect()
    want = [(d, a, o) for d in (2, 3) for a in LAT.tolist() if 47.1 <= a <= 49 for o in LON.tolist() if -125 <= o <= -124]
    assert sorted((r.time.day, r.latitude, r.longitude) for r in rows) == sorted(want)  # each place once, though tiles meet
    asked = [x for x in Server.asked if "griddap" in x]
    assert len(asked) == len(set(asked)) == 2 * 2 and all("2024-07-02" in x or "2024-07-03" in x for x in asked)
    assert all(47.1 <= float(v) <= 49 for x in asked for v in re.findall(r"\((4[\d.]+)\)", x))
    before = len(Server.asked)
    assert got.count() == len(want) and len(Server.asked) == before  # all from the cache
    with pytest.raises(Exception, match="limits of time"):
        grid().count()
    with pytest.raises(Exception, match="is not in"):
        grid(time=(at("2025-01-01T00:00"), at("2025-01-02T00:00"))).count()


def test_layers_of_all_families(spark, server, tmp_path):
    published = {}

    def publish(rows, layers, family, day, sha, bbox, errors):
        published[family, day] = rows.collect(), errors

    told = collect.collect(spark, "x", str(tmp_path), settings(server), "sha", list(runner.FAMILIES), lambda f: [DAY], publish)
    failed = {t["family"]: t["failed"] for t in told}
    assert {f for f, why in failed.items() if why} == {"productivity"} and "tidal_model" not in failed  # its server has no such dataset
    sst, _ = published["ocean_temperature", DAY]
    assert {(r.lat, r.lon) for r in sst} == {(a, o) for a in LAT.tolist() for o in LON.tolist() if 46.85 <= a <= 50 and -125.8 <= o <= -121.6} and all(r.quality == 5 and abs(r.sst - (r.lat + r.lon / 1000)) < 1e-4 for r in sst)
    flow, _ = published["currents", DAY]
    assert len(flow) == 6 * 12 and {(r.u, r.v, r.depth) for r in flow} == {(3.0, 4.0, 30.0)} and {r.t for r in flow} == {0, 4, 8, 12, 16, 20} and len({(r.t, r.y, r.x) for r in flow}) == 72
    far, _ = published["offshore_currents", DAY]
    assert len(far) == 32 and {r.t for r in far} == set(range(8)) and {(round(r.u, 6), round(r.v, 6)) for r in far} == {(3.0, 4.0)} and len({(r.y, r.x) for r in far}) == 4
    levels, errors = published["tides", DAY]
    assert sorted((r.seed, r.value) for r in levels) == sorted([("CHS:07120", h / 2) for h in range(24)] + [("NOAA:9449880", float(h)) for h in range(24)])
    assert len(errors) == 2 and "no series" in errors[0] and "inventory" in errors[1]
    rivers, errors = published["river_discharge", DAY]
    assert sorted((r.seed, r.day, r.value, r.unit) for r in rivers) == [("ECCC:08MF005", DAY, "6000.0", "m^3/s"), ("ECCC:08MF005", DAY, "6001.0", "m^3/s"), ("USGS:USGS-1", DAY, "100", "ft^3/s")]
    assert len(errors) == 1 and errors[0].startswith("USGS-2: ")
    before = len(Server.asked)
    again = collect.collect(spark, "x", str(tmp_path), settings(server), "sha", ["tides", "ocean_temperature"], lambda f: [DAY], publish, offline=True)
    assert not any(t["failed"] for t in again) and len(Server.asked) == before


def test_collect_then_build(spark, server, tmp_path):
    """A station's error reaches the manifest; a day without a layer is unavailable."""
    from pelagia.functions import cells

    own = settings(server)
    place = spark.createDataFrame([(48.5, -123.5), (20.0, 10.0)], "lat double, lon double")
    support = {res: place.select(cells.hex_cell(F.col("lat"), F.col("lon"), res).alias("cell"), F.lit(2.0).alias("area")) for res in (6, 8)}
    fixed = {"tide_distances": support[8].limit(1).select(F.lit("CHS:07120").alias("seed"), "cell", F.lit(0.0).alias("distance"))}
    layers, out = f"{tmp_path}/layers", f"{tmp_path}/out"
    told = collect.collect(spark, layers, f"{tmp_path}/cache", own, "sha", ["tides", "currents"], lambda f: [DAY], runner.publish_layer)
    assert [t["failed"] for t in told] == [None, None]
    got = {m["family"]: m for m in runner.build(spark, layers, runner.Region(support, fixed, own), out, DAY, DAY, ("tides", "currents"), "sha")}
    assert got["tides"]["status"] == "partial" and len(got["tides"]["source_errors"]) == 2 and got["currents"]["status"] == "available"
    values = {r.CURRENT_SPEED_SAMPLE_MEAN_MS for r in spark.read.parquet(f"{out}/currents").collect()}
    assert values == {5.0, None}
