"""Format ``marine_netcdf``: classic NetCDF files (versions 1, 2 and 5) as long rows.

A file's header is read first, alone; what it tells decides the columns: the variables' dimensions in order, then the variables.
A partition is a block of cells, so many tasks read one file, each only its own bytes. Limits of coordinates (``limited``) become
index ranges, so what they rule out is never read. Files are opened through Arrow's
file systems, on this machine or in a store. Fill and missing values and NaN become NULL; scale and offset are applied;
a time axis ("hours since ...") becomes a timestamp. Options: ``path`` (files, comma-separated), ``variables`` (of the same
dimensions), ``cells`` (of a partition, a million by default), ``limits``. Files that are not of one shape in names and units are an error.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.store import opened

# The format's tags, its types and the values of cells that were never written.
DIMENSION, VARIABLE, ATTRIBUTE, STREAMING = 10, 11, 12, 0xFFFFFFFF
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
UNWRITTEN = {3: -32767, 4: -2147483647, 5: 9.969209968386869e36, 6: 9.969209968386869e36, 8: 65535, 9: 4294967295, 10: -9223372036854775806, 11: 18446744073709551614}
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    dims: list[str]
    kind: int
    begin: int
    attributes: dict
    record: bool

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(TYPES[self.kind])


@dataclass
class Header:
    dims: dict[str, int]
    attributes: dict
    variables: dict[str, Variable]
    #: Bytes from one record to the next.
    stride: int

    def shape(self, variable: str) -> list[int]:
        return [self.dims[d] for d in self.variables[variable].dims]


def header(f: pa.NativeFile) -> Header:
    """The header of a file; more of it is read until it is whole."""
    size, total = 1 << 14, f.size()
    while True:
        try:
            return _parsed(f.read_at(min(size, total), 0), total)
        except struct.error:
            if size >= total:
                raise ValueError("the header is cut off") from None
            size *= 4


def _parsed(data: bytes, total: int) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise ValueError("no classic NetCDF file")
    version, at = data[3], 4
    number, offset = ">Q" if version == 5 else ">I", ">I" if version == 1 else ">Q"

    def take(form: str) -> int:
        nonlocal at
        (value,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        return value

    def block(n: int) -> bytes:
        nonlocal at
        held = data[at : at + n]
        at += -(-n // 4) * 4
        if at > len(data):
            raise struct.error
        return held

    def listed(tag: int) -> range:
        found, n = take(">I"), take(number)
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header has no list where one belongs")
        return range(n)

    def name() -> str:
        return block(take(number)).decode()

    def attributes() -> dict:
        out = {}
        for _ in listed(ATTRIBUTE):
            key, kind = name(), take(">I")
            n = take(number)
            held = block(n * np.dtype(TYPES[kind]).itemsize)
            out[key] = held.decode("utf-8", "replace").rstrip("\0") if kind == 2 else np.frombuffer(held, TYPES[kind])[:n].tolist()
        return out

    records = take(number)
    dims = {}
    for _ in listed(DIMENSION):
        key = name()
        dims[key] = take(number)
    unlimited = next((d for d, n in dims.items() if n == 0), None)
    own, found, sizes = attributes(), {}, {}
    for _ in listed(VARIABLE):
        key = name()
        over = [list(dims)[take(number)] for _ in range(take(number))]
        told = attributes()
        kind = take(">I")
        take(number)  # the size told here is cut off for large variables
        record = bool(over) and over[0] == unlimited
        found[key] = Variable(over, kind, take(offset), told, record)
        if record:
            sizes[key] = math.prod(dims[d] for d in over[1:]) * np.dtype(TYPES[kind]).itemsize
    # The only record variable is not padded.
    stride = sum(sizes.values()) if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes.values())
    if unlimited is not None:
        if records == (STREAMING if version < 5 else (1 << 64) - 1):
            records = (total - min(found[k].begin for k in sizes)) // stride if sizes else 0
        dims[unlimited] = records
    return Header(dims, own, found, stride)


def values(f: pa.NativeFile, h: Header, name: str, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The raw values of a variable in a block of index ranges. What is read is whole rows of the last dimension, one run for each index of the ones before the last two."""
    v, shape = h.variables[name], h.shape(name)
    if not shape:
        return np.frombuffer(f.read_at(v.dtype.itemsize, v.begin), v.dtype)
    step, inner = v.dtype.itemsize, shape[1:] if v.record else shape
    steps = [math.prod(inner[k + 1 :]) * step for k in range(len(inner))]
    if v.record:
        steps = [h.stride, *steps]
    free = ranges[-2:] if len(shape) > 1 and not (v.record and len(shape) == 2) else ranges[-1:]
    fixed = ranges[: len(ranges) - len(free)]
    whole = not (v.record and len(shape) == 1)  # the cells of a one-dimensional record variable lie a record apart
    out = []
    for place in np.ndindex(*(b - a for a, b in fixed)):
        begin = v.begin + sum((a + p) * s for (a, _), p, s in zip(fixed, place, steps, strict=False))
        low, high = free[0]
        if not whole:
            out += [np.frombuffer(f.read_at(step, begin + k * h.stride), v.dtype) for k in range(low, high)]
            continue
        row = steps[len(fixed)]
        held = np.frombuffer(f.read_at((high - low) * row, begin + low * row), v.dtype)
        out.append(held.reshape(high - low, -1)[:, slice(*free[1])].ravel() if len(free) == 2 else held)
    return np.concatenate(out) if out else np.zeros(0, v.dtype)


def decoded(raw: np.ndarray, v: Variable) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles, and where there is one."""
    told = v.attributes
    absent = [*told.get("_FillValue", [UNWRITTEN[v.kind]] if v.kind in UNWRITTEN else []), *told.get("missing_value", [])]
    there = ~np.isin(raw, np.array(absent, v.dtype)) if absent else np.ones(len(raw), bool)
    out = raw.astype(float) * told.get("scale_factor", [1.0])[0] + told.get("add_offset", [0.0])[0]
    return out, there & ~np.isnan(out)


def time_unit(v: Variable | None) -> tuple[float, datetime] | None:
    """Seconds of a unit and the moment it counts from, of a variable in "units since moment" of the common calendar."""
    unit, since, moment = (v.attributes.get("units", "") if v else "").partition(" since ")
    seconds = SECONDS.get(unit.strip().rstrip("s").replace("sec", "second").replace("secondond", "second").replace("hr", "hour"))
    if not since or seconds is None:
        return None
    if v.attributes.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"calendar {v.attributes['calendar']} is not read")
    day, _, clock = moment.strip().replace("T", " ").removesuffix("UTC").removesuffix("Z").strip().partition(" ")
    year, month, date = (int(x) for x in day.split("-"))
    at = datetime(year, month, date, tzinfo=UTC)
    if clock:
        hour, minute, second = (*clock.split(":"), "0", "0")[:3]
        at += timedelta(hours=int(hour), minutes=int(minute), seconds=float(second))
    return seconds, at


def axis(f: pa.NativeFile, h: Header, dim: str) -> tuple[np.ndarray, bool]:
    """Coordinates of a dimension (its index where it has no variable), and whether they are microseconds since 1970."""
    v = h.variables.get(dim)
    if v is None or v.dims != [dim]:
        return np.arange(h.dims[dim], dtype=float), False
    got, there = decoded(values(f, h, dim, [(0, h.dims[dim])]), v)
    if not there.all():
        raise ValueError(f"{dim} has missing coordinates")
    if unit := time_unit(v):
        seconds, at = unit
        base = round((at - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
        return base + np.rint(got * seconds * 1e6).astype(np.int64), True
    return got, False


@dataclass
class Block(InputPartition):
    path: str
    ranges: list[tuple[int, int]]

    def __init__(self, path: str, ranges: list[tuple[int, int]]):
        super().__init__((path, ranges))
        self.path, self.ranges = path, ranges


def told_limits(options: dict) -> dict[str, tuple]:
    return {k: tuple(v) for k, v in json.loads(options.get("limits", "{}")).items()}


def limited(reader: DataFrameReader, **limits: tuple) -> DataFrame:
    """What ``reader`` loads within limits (low, high; both belong to it) of coordinates, known to the source before it reads: numbers, or moments with a zone.

    They are an option, not filters that Spark pushes down: Spark 4.1 keeps a Python source's pushed filters with the relation, so a later query of it would miss rows.
    """
    told = {k: [x.isoformat() if isinstance(x, datetime) else float(x) for x in v] for k, v in limits.items()}
    rows = reader.option("limits", json.dumps(told)).load()
    for k, (low, high) in limits.items():
        rows = rows.where(F.col(k).between(F.lit(low), F.lit(high)))
    return rows


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.variables = [v.strip() for v in options["variables"].split(",")]
        self.cells = int(options.get("cells", 1 << 20))
        self.limits = told_limits(options)
        with opened(self.paths[0]) as f:
            self.dims, self.times, self.told = self.form(header(f))
        self.shown = [v for v in self.variables if v not in self.dims]  # a coordinate is there already

    def form(self, h: Header) -> tuple[list[str], list[str], list]:
        if lacking := [v for v in self.variables if v not in h.variables or h.variables[v].kind == 2]:
            raise ValueError(f"no variable of numbers: {lacking}")
        dims = h.variables[self.variables[0]].dims
        if any(h.variables[v].dims != dims for v in self.variables):
            raise ValueError("the variables have different dimensions")
        return dims, [d for d in dims if time_unit(h.variables.get(d))], [h.variables[v].attributes.get("units") for v in self.variables]

    def schema(self) -> str:
        return ", ".join([*(f"`{d}` {'timestamp' if d in self.times else 'double'}" for d in self.dims), *(f"`{v}` double" for v in self.shown)])

    def kept(self, dim: str, at: np.ndarray, time: bool) -> list[tuple[int, int]]:
        """Runs of indexes whose coordinates are within the limits."""
        good = np.ones(len(at), bool)
        if dim in self.limits:
            low, high = (round(datetime.fromisoformat(x).timestamp() * 1e6) if time else x for x in self.limits[dim])
            good = (at >= low) & (at <= high)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with opened(path) as f:
                h = header(f)
                if self.form(h) != (self.dims, self.times, self.told):
                    raise ValueError(f"{path} is not of one shape with {self.paths[0]}")
                blocks: list[list[tuple[int, int]]] = [[]]
                for dim in self.dims:
                    blocks = [[*b, run] for b in blocks for run in self.kept(dim, *axis(f, h, dim))]
            for block in blocks:
                out += [Block(path, part) for part in cut(block, self.cells)]
        return out

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there are no partitions
            return
        with opened(partition.path) as f:
            yield rows(f, header(f), self.dims, self.shown, partition.ranges)


def rows(f: pa.NativeFile, h: Header, dims: list[str], variables: list[str], ranges: list[tuple[int, int]]) -> pa.RecordBatch:
    """A block of cells as rows: coordinates, then variables."""
    shape, columns = [b - a for a, b in ranges], []
    for k, (dim, (a, b)) in enumerate(zip(dims, ranges, strict=True)):
        at, time = axis(f, h, dim)
        grid = np.broadcast_to(at[a:b].reshape([-1 if k == j else 1 for j in range(len(shape))]), shape).ravel()
        columns.append(pa.array(grid, pa.timestamp("us", tz="UTC") if time else pa.float64()))
    for v in variables:
        got, there = decoded(values(f, h, v, ranges), h.variables[v])
        columns.append(pa.array(got, mask=~there))
    return pa.RecordBatch.from_arrays(columns, [*dims, *variables])


def cut(block: list[tuple[int, int]], cells: int) -> list[list[tuple[int, int]]]:
    """Parts of a block of about ``cells`` cells, cut along its first dimensions."""
    if not block or math.prod(b - a for a, b in block) <= cells:
        return [block]
    (a, b), rest = block[0], block[1:]
    inner = math.prod(y - x for x, y in rest)
    if inner > cells:
        return [[(k, k + 1), *part] for k in range(a, b) for part in cut(rest, cells)]
    step = max(1, cells // max(1, inner))
    return [[(k, min(b, k + step)), *rest] for k in range(a, b, step)]


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marine_netcdf"

    def schema(self) -> str:
        return NetcdfReader(dict(self.options)).schema()

    def reader(self, schema) -> DataSourceReader:
        return NetcdfReader(dict(self.options))


def attributes(path: str, variable: str | None = None) -> dict:
    """Attributes of a file or of one of its variables, for checks of units and spans."""
    with opened(path) as f:
        h = header(f)
    return h.attributes if variable is None else h.variables[variable].attributes
