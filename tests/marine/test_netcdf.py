"""Classic NetCDF files written here, read back as rows."""

from __future__ import annotations

import math
import struct
from datetime import datetime

import numpy as np
import pytest
from pelagia.sources import netcdf
from pyspark.sql import functions as F

KINDS = {"i1": 1, "S1": 2, ">i2": 3, ">i4": 4, ">f4": 5, ">f8": 6, "u1": 7, ">u2": 8, ">u4": 9, ">i8": 10, ">u8": 11}


def written(path, dims: dict, variables: dict, version: int = 1, unlimited: str | None = None, streaming: bool = False, attributes: dict | None = None) -> str:
    """variables: name -> (dims, array, attributes)."""
    number, offset = (">Q" if version == 5 else ">I"), (">I" if version == 1 else ">Q")
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(number, len(s.encode())) + pad(s.encode())
    listed = lambda tag, items: struct.pack(">I", tag if items else 0) + struct.pack(number, len(items)) + b"".join(items)

    def attribute(key, value) -> bytes:
        if isinstance(value, str):
            return name(key) + struct.pack(">I", 2) + struct.pack(number, len(value.encode())) + pad(value.encode())
        x = np.atleast_1d(value)
        return name(key) + struct.pack(">I", KINDS[x.dtype.str.replace("|", "").replace("<", ">")]) + struct.pack(number, len(x)) + pad(x.astype(x.dtype.newbyteorder(">")).tobytes())

    index, records = list(dims), dims.get(unlimited, 0)
    own = {k: (d, np.asarray(a), t, bool(d) and d[0] == unlimited) for k, (d, a, t) in variables.items()}
    kind = lambda a: a.dtype.str.replace("|", "").replace("<", ">")
    size = lambda a, rec: (math.prod(a.shape[1:]) if rec else a.size) * a.dtype.itemsize
    many = sum(rec for *_, rec in own.values())
    padded = lambda n, rec: n if rec and many == 1 else -(-n // 4) * 4

    def head(begins: dict) -> bytes:
        told = (1 << 64) - 1 if version == 5 else 0xFFFFFFFF
        out = b"CDF" + bytes([version]) + struct.pack(number, told if streaming else records)
        out += listed(10, [name(d) + struct.pack(number, 0 if d == unlimited else n) for d, n in dims.items()])
        out += listed(12, [attribute(k, v) for k, v in (attributes or {}).items()])
        return out + listed(11, [name(k) + struct.pack(number, len(d)) + b"".join(struct.pack(number, index.index(x)) for x in d) + listed(12, [attribute(x, y) for x, y in t.items()])
                                 + struct.pack(">I", KINDS[kind(a)]) + struct.pack(number, padded(size(a, rec), rec)) + struct.pack(offset, begins[k]) for k, (d, a, t, rec) in own.items()])

    begins, at = dict.fromkeys(own, 0), len(head(dict.fromkeys(own, 0)))
    body = b""
    for k, (_, a, _, rec) in own.items():
        if not rec:
            begins[k] = at + len(body)
            body += pad(a.astype(a.dtype.newbyteorder(">")).tobytes())
    start = at + len(body)
    for k, (_, a, _, rec) in own.items():
        if rec:
            begins[k] = start
            start += padded(size(a, rec), rec)
    for r in range(records):
        for _, a, _, rec in own.values():
            if rec:
                held = a[r : r + 1].astype(a.dtype.newbyteorder(">")).tobytes()
                body += held + b"\0" * (padded(len(held), True) - len(held))
    with open(path, "wb") as f:
        f.write(head(begins) + body)
    return str(path)


def grid(path, version=1, unlimited="time", streaming=False, hours=5, start=0):
    rng = np.random.default_rng(version)
    sst = rng.integers(-300, 3000, (hours, 4, 6)).astype(np.int16)
    sst[:1, 0, 0], sst[1:2, 2, 3] = -999, -32000
    quality = rng.integers(0, 6, (hours, 4, 6)).astype(np.int8)
    u = rng.normal(size=(hours, 4, 6)).astype(np.float32)
    u[2:3, 1, 1] = np.nan
    told = {"sst": {"_FillValue": np.int16(-999), "missing_value": np.int16(-32000), "scale_factor": 0.01, "add_offset": 1.5, "units": "degree_C"}, "u": {}, "quality": {}}
    dims = ["time", "latitude", "longitude"]
    variables = {"time": (["time"], np.arange(start, start + hours) * 4.0 + 0.5, {"units": "hours since 2024-07-01 00:00:00"}), "latitude": (["latitude"], np.array([50.0, 49.5, 49.0, 48.5]), {}),
                 "longitude": (["longitude"], np.linspace(-125, -122.5, 6), {}), "sst": (dims, sst, told["sst"]), "quality": (dims, quality, {}), "u": (dims, u, {}),
                 "depth": (["latitude", "longitude"], rng.normal(size=(4, 6)), {}), "label": (["longitude"], np.array([b"a"] * 6), {})}
    written(path, {"time": hours, "latitude": 4, "longitude": 6}, variables, version, unlimited, streaming, {"title": "a grid", "n": np.int32(7)})
    return variables


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(netcdf.NetcdfSource)
    return lambda path, variables, limits=None, **more: netcdf.limited(spark.read.format("marine_netcdf").options(path=path, variables=variables, **more), **(limits or {}))


@pytest.mark.parametrize(("version", "unlimited", "streaming", "cells"), [(1, "time", False, 1000), (2, "time", True, 7), (5, "time", False, 1), (1, None, False, 50), (5, "time", True, 1 << 20)])
def test_round_trip(source, tmp_path, version, unlimited, streaming, cells):
    path = f"{tmp_path}/a.nc"
    v = grid(path, version, unlimited, streaming)
    df = source(path, "sst, quality, u", cells=cells)
    assert df.dtypes == [("time", "timestamp"), ("latitude", "double"), ("longitude", "double"), ("sst", "double"), ("quality", "double"), ("u", "double")]
    got = {(int(r.s - 1719792000), r.latitude, r.longitude): (r.sst, r.quality, r.u) for r in df.withColumn("s", F.unix_seconds("time")).collect()}
    assert len(got) == df.count() == 120
    for t in range(5):
        for y in range(4):
            for x in range(6):
                a, q, u = (v[k][1][t, y, x] for k in ("sst", "quality", "u"))
                row = got[1800 + t * 14400, 50 - 0.5 * y, float(v["longitude"][1][x])]
                assert row[0] is None if a in (-999, -32000) else abs(row[0] - (a * 0.01 + 1.5)) < 1e-12
                assert row[1] == q and (row[2] is None if np.isnan(u) else row[2] == u)
    flat = source(path, "depth").collect()
    assert {(r.latitude, r.longitude): r.depth for r in flat} == {(50 - 0.5 * y, float(v["longitude"][1][x])): v["depth"][1][y, x] for y in range(4) for x in range(6)}
    assert [r.time for r in source(path, "time").orderBy("time").collect()] and netcdf.attributes(path) == {"title": "a grid", "n": [7]} and netcdf.attributes(path, "sst")["units"] == "degree_C"


def test_single_record_variable_is_not_padded(source, tmp_path):
    x = np.arange(15, dtype=np.int8).reshape(5, 3)
    path = written(f"{tmp_path}/b.nc", {"t": 5, "k": 3}, {"x": (["t", "k"], x, {})}, 1, "t")
    assert sorted(tuple(r) for r in source(path, "x", cells=4).collect()) == [(float(a), float(b), float(x[a, b])) for a in range(5) for b in range(3)]


def test_limits_become_index_ranges(source, spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(f"{tmp_path}/{k}.nc")
        grid(paths[-1], hours=5, start=5 * k)
    df = source(",".join(paths), "u", cells=10)
    assert df.count() == 240 and df.rdd.getNumPartitions() == 40  # a row of six each, of 4 rows, 5 hours and 2 files
    late = datetime.fromisoformat("2024-07-01T20:00:00+00:00"), datetime.fromisoformat("2024-08-01T00:00:00+00:00")
    near = source(",".join(paths), "u", {"latitude": (49.0, 49.5), "longitude": (-125.0, -124.5), "time": late}, cells=10)
    assert near.count() == 2 * 2 * 5 and near.rdd.getNumPartitions() < 20 and df.count() == 240
    reader = netcdf.NetcdfReader({"path": paths[0], "variables": "u", "limits": '{"latitude": [48.9, 49.1]}'})
    assert [p.ranges for p in reader.partitions()] == [[(0, 5), (2, 3), (0, 6)]]
    assert source(paths[0], "u", {"latitude": (60, 70)}).count() == 0
    assert source(paths[0], "u").where(F.col("time") == F.lit(datetime(2024, 7, 1, 4, 30)).cast("timestamp")).count() == 24


def test_no_rows_and_wrong_files(source, tmp_path):
    path = f"{tmp_path}/c.nc"
    grid(path, hours=0)
    assert source(path, "u").count() == 0
    grid(f"{tmp_path}/d.nc")
    with pytest.raises(Exception, match="different dimensions"):
        source(f"{tmp_path}/d.nc", "u, depth").count()
    with pytest.raises(Exception, match="no variable"):
        source(f"{tmp_path}/d.nc", "label").count()
    with pytest.raises(ValueError, match="no classic"):
        (tmp_path / "e.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
        netcdf.attributes(f"{tmp_path}/e.nc")
    whole = (tmp_path / "d.nc").read_bytes()
    (tmp_path / "f.nc").write_bytes(whole[:100])
    with pytest.raises(ValueError, match="cut off"):
        netcdf.attributes(f"{tmp_path}/f.nc")
    written(f"{tmp_path}/g.nc", {"k": 2}, {"x": (["k"], np.zeros(2), {"units": "m"})})
    written(f"{tmp_path}/h.nc", {"k": 2}, {"x": (["k"], np.zeros(2), {"units": "km"})})
    with pytest.raises(Exception, match="one shape"):
        source(f"{tmp_path}/g.nc,{tmp_path}/h.nc", "x").count()
