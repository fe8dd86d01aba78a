"""Grids and stations of public servers as Spark sources.

``marine_remote_grid`` reads gridded datasets of ERDDAP servers: limits of time and place (``netcdf.limited``) become the request, so nothing else is sent;
a partition is one day and one tile, fetched by the task that reads it through the request cache. ``stations`` fetches series of many
stations in tasks, a few at a time, and gives each station's rows or one row with its error. The cache is a folder that all executors see.
"""

from __future__ import annotations

import json
import math
import urllib.error
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import quality
from ..sinks.store import opened
from . import netcdf
from .cache import RequestCache
from .readers import erddap_attributes

FAILURES = (ValueError, KeyError, OSError, StopIteration, urllib.error.URLError)


@dataclass
class Piece(InputPartition):
    url: str
    limits: dict[str, tuple]

    def __init__(self, url: str, limits: dict[str, tuple]):
        super().__init__((url, limits))
        self.url, self.limits = url, limits


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.dataset, self.cache = options["base"].rstrip("/"), options["dataset"], options["cache"]
        self.variables = [v.strip() for v in options["variables"].split(",")]
        self.axes = [a.strip() for a in options.get("axes", "time,latitude,longitude").split(",")]
        self.units = dict(u.split("=", 1) for u in options["units"].split(",")) if options.get("units") else {}
        self.fixed = dict(x.split("=", 1) for x in options["fixed"].split(",")) if options.get("fixed") else {}
        self.tile = float(options.get("tile", math.inf))
        self.first, self.last, self.stride = options.get("first", "00:00:00"), options.get("last", "23:59:59"), int(options.get("stride", 1))
        self.offline = str(options.get("offline", "false")).lower() == "true"
        self.limits = netcdf.told_limits(options)

    def schema(self) -> str:
        return ", ".join([*(f"`{a}` {'timestamp' if a == 'time' else 'double'}" for a in self.axes), *(f"`{v}` double" for v in self.variables)])

    def partitions(self) -> list[InputPartition]:
        told = erddap_attributes(RequestCache(self.cache, self.offline).json(f"{self.base}/info/{self.dataset}/index.json"))
        for v, unit in self.units.items():
            quality.require_units(told, v, unit)
        days: list[str | None] = [None]
        if "time" in self.axes:
            if "time" not in self.limits:
                raise ValueError("a remote grid is read for some days: limits of time are needed")
            low, high = (datetime.fromisoformat(x).astimezone(UTC) for x in self.limits["time"])
            days = [str(low.date() + timedelta(days=k)) for k in range((high.date() - low.date()).days + 1) if datetime.combine(low.date() + timedelta(days=k), datetime.min.time(), UTC) <= high]
            for day in days:
                quality.require_covered(told, day)
        tiles: list[dict[str, tuple]] = [{}]
        for a in self.axes:
            if a != "time" and a in self.limits:
                low, high = self.limits[a]
                many = 1 if math.isinf(self.tile) else max(1, math.ceil((high - low) / self.tile))
                ends = [low + (high - low) * k / many for k in range(many)] + [high]
                tiles = [t | {a: (ends[k], ends[k + 1], k + 1 == many)} for t in tiles for k in range(many)]
        return [Piece(self.url(day, tile, told), tile | ({"time": (day,)} if day else {})) for day in days for tile in tiles]

    def url(self, day: str | None, tile: dict[str, tuple], told: dict) -> str:
        parts = ""
        for a in self.axes:
            if a == "time":
                parts += f"[({day}T{self.first}Z):{self.stride}:({day}T{self.last}Z)]"
            elif a in tile:
                ends = [float(x) for x in told.get((a, "actual_range"), "0,1").split(",")]
                low, high = tile[a][:2]
                parts += f"[({high}):1:({low})]" if ends[0] > ends[1] else f"[({low}):1:({high})]"
            else:
                parts += f"[{self.fixed[a]}]" if a in self.fixed else "[0:1:last]"
        return f"{self.base}/griddap/{self.dataset}.nc?{','.join(v + parts for v in self.variables)}"

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        path = RequestCache(self.cache, self.offline).get(partition.url, suffix=".nc")
        with opened(str(path)) as f:
            h = netcdf.header(f)
            for v in self.variables:
                if h.variables[v].dims != self.axes:
                    raise ValueError(f"{v} has the axes {h.variables[v].dims}")
                if self.units.get(v, found := h.variables[v].attributes.get("units")) != found:
                    raise quality.CheckError(f"{v} is in {found}")
            batch = netcdf.rows(f, h, self.axes, self.variables, [(0, n) for n in h.shape(self.variables[0])])
        keep = pa.array([True] * batch.num_rows)
        for a, limit in partition.limits.items():  # servers answer with the nearest points, which may lie beyond
            at = batch.column(a)
            if a == "time":
                keep = pc.and_(keep, pc.equal(pc.strftime(at, "%Y-%m-%d"), limit[0]))
            else:
                low, high, closed = limit
                keep = pc.and_(keep, pc.and_(pc.greater_equal(at, low), pc.less_equal(at, high) if closed else pc.less(at, high)))
        yield batch.filter(keep)


class RemoteGrid(DataSource):
    """Options: base, dataset, variables, cache; axes (time,latitude,longitude), units (v=unit,...), fixed (axis=index,...), tile (degrees), first and last (clock of a day), stride, offline, limits."""

    @classmethod
    def name(cls) -> str:
        return "marine_remote_grid"

    def schema(self) -> str:
        return GridReader(dict(self.options)).schema()

    def reader(self, schema) -> DataSourceReader:
        return GridReader(dict(self.options))


Parsed = list[tuple[datetime | None, str | None, str | None]]  # time, value as told, unit


def _utc(text: str) -> datetime:
    at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def _text(value) -> str | None:
    return None if value is None else str(value)


def water_levels(answer, provider: str) -> Parsed:
    """Hourly predictions of a station: a list of events, or a map with predictions."""
    if provider == "CHS":
        if not isinstance(answer, list):
            raise ValueError(json.dumps(answer)[:300])
        return [(_utc(r["eventDate"]), _text(r["value"]), "m") for r in answer]
    if "predictions" not in answer:
        raise ValueError(json.dumps(answer)[:300])
    return [(_utc(r["t"]), _text(r["v"]), "m") for r in answer["predictions"]]


def daily_discharge(answer, provider: str) -> Parsed:
    """Daily means of a gauge: features of a collection, each with its day."""
    out = []
    for f in answer["features"]:
        p = f["properties"]
        if provider == "ECCC":
            out.append((_utc(p["DATE"][:10]), _text(p["DISCHARGE"]), "m^3/s"))
        else:
            if (p.get("parameter_code"), p.get("statistic_id")) != ("00060", "00003"):
                raise ValueError("no daily mean of discharge")
            out.append((_utc(p["time"][:10]), _text(p["value"]), p["unit_of_measure"]))
    return out


def stations(requests: DataFrame, cache: str, parse: Callable[[object, str], Parsed], offline: bool = False, tasks: int = 4, at_once: int = 4) -> DataFrame:
    """(seed, station, ts, value, unit, error) of ``requests`` (seed, provider, station, url; pages of a collection are followed).

    At most ``tasks`` times ``at_once`` requests run at a time. A station that fails, or has no URL, gives one row with its error and leaves the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = RequestCache(cache, offline)

        def one(seed, provider, station, url) -> list[tuple]:
            try:
                if url is None:
                    raise ValueError("the station is not in the inventory")
                answer = held.json(url)
                if isinstance(answer, dict) and "features" in answer:
                    answer = {"features": [f for p in held.pages(url) for f in json.loads(p.read_text())["features"]]}
                return [(seed, station, *row, None) for row in parse(answer, provider)]
            except FAILURES as e:
                return [(seed, station, None, None, None, f"{type(e).__name__}: {e}")]

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                asked = frame[["seed", "provider", "station", "url"]].astype(object).where(frame[["seed", "provider", "station", "url"]].notna(), None)
                rows = [row for own in pool.map(lambda r: one(*r), asked.itertuples(index=False, name=None)) for row in own]
                yield pd.DataFrame(rows, columns=["seed", "station", "ts", "value", "unit", "error"]).astype({"ts": "datetime64[us, UTC]"})

    return requests.repartition(tasks, "station").mapInPandas(run, "seed string, station string, ts timestamp, value string, unit string, error string")


def errors_of(rows: DataFrame) -> list[str]:
    """What failed, a line a station, for the manifest."""
    return [f"{r.station}: {r.error}" for r in rows.where(F.col("error").isNotNull()).select("station", "error").distinct().orderBy("station", "error").collect()]  # one a station at most


def day_limits(day: str) -> tuple[datetime, datetime]:
    low = datetime.combine(date.fromisoformat(day), datetime.min.time(), UTC)
    return low, low + timedelta(days=1) - timedelta(microseconds=1)
