"""From public servers to published daily layers (S6-S10, section 3.1): what ``build`` reads.

Each family's layer of a day is a DataFrame over the sources of ``sources.remote``; the runner writes it with its manifest. Stations that
fail are told in the manifest (``partial``); a server that fails, or does not hold the day, leaves the family without a layer of that day.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid, quality
from ..sources import netcdf, readers, remote
from ..sources.cache import RequestCache, canonical
from ..sources.config import Settings

Layer = tuple[DataFrame, list[str]]  # rows, errors of stations


def prepare(spark: SparkSession) -> None:
    spark.dataSource.register(remote.RemoteGrid)
    spark.dataSource.register(netcdf.NetcdfSource)


def _grid(spark: SparkSession, cache: str, base: str, dataset: str, variables: str, axes: str, offline: bool, limits: dict[str, tuple], **more) -> DataFrame:
    options = {"base": base, "dataset": dataset, "variables": variables, "axes": axes, "cache": cache, "offline": str(offline)} | more
    return netcdf.limited(spark.read.format("marine_remote_grid").options(**options), **limits)


def satellite(spark: SparkSession, cache: str, s: Settings, family: str, day: str, offline: bool = False) -> Layer:
    """A day's composite in the area; exactly one time of that day."""
    if family not in s.satellites:
        raise quality.CheckError(f"{family} has no satellite")
    own, box = s.satellites[family], s.bbox
    axes = f"time,{'altitude,' if own.altitude else ''}latitude,longitude"
    limits = {"time": remote.day_limits(day), "latitude": (box.south, box.north), "longitude": (box.west, box.east)}
    rows = _grid(spark, cache, s.satellite_base, own.dataset, ",".join(filter(None, (own.variable, own.quality_variable))), axes, offline, limits, units=f"{own.variable}={own.units}", **({"fixed": "altitude=0"} if own.altitude else {}))
    quality.require_times(rows.select("time").distinct(), day, 1, "time")
    value = F.col(own.variable).alias("sst" if family == "ocean_temperature" else "chlorophyll")
    extra = [] if family != "ocean_temperature" else [F.col(own.quality_variable).cast("int").alias("quality") if own.quality_variable else F.lit(own.quality_min).alias("quality")]
    return rows.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), value, *extra), []


def currents(spark: SparkSession, cache: str, s: Settings, family: str, day: str, offline: bool = False) -> Layer:
    """Both velocities and the geometry of the same cells (V13); each has the day's times (V1)."""
    place = ["gridY", "gridX"]
    clock = {"first": "00:30:00", "last": "23:30:00", "stride": str(s.current_interval_hours), "fixed": "depth=0"}
    u, v = (_grid(spark, cache, s.salish_base, d, n, "time,depth,gridY,gridX", offline, {"time": remote.day_limits(day)}, units=f"{n}=m s-1", **clock).select("time", *place, F.col(n).alias(k))
            for d, n, k in ((s.current_u_dataset, "uVelocity", "u"), (s.current_v_dataset, "vVelocity", "v")))
    geometry = _grid(spark, cache, s.salish_base, s.current_geometry_dataset, "latitude,longitude,bathymetry", "gridY,gridX", offline, {})
    for rows in (u, v):
        quality.require_times(rows.select("time").distinct(), day, 24 // s.current_interval_hours, "time")
    both = grid.aligned(grid.aligned(u, v, ["time", *place]), geometry, place)
    return both.select(F.hour("time").alias("t"), F.col("gridY").cast("int").alias("y"), F.col("gridX").cast("int").alias("x"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "u", "v", F.col("bathymetry").alias("depth")), []


def offshore_currents(spark: SparkSession, cache: str, s: Settings, family: str, day: str, offline: bool = False) -> Layer:
    """A subset service that tells its time span; eight three-hourly samples of the surface (V2)."""
    held, base, box = RequestCache(cache, offline), f"{s.offshore_current_base}/{day[:4]}", s.bbox
    readers.require_span(held.get(f"{base}/dataset.xml", suffix=".xml").read_text(), day)
    asked = {"var": "water_u,water_v", "north": str(box.north), "south": str(box.south), "west": str(box.west), "east": str(box.east), "horizStride": "1",
             "time_start": f"{day}T00:00:00Z", "time_end": f"{day}T21:00:00Z", "timeStride": "1", "vertCoord": "0", "accept": "netcdf"}
    path = str(held.get(base, asked, ".nc"))
    for v in ("water_u", "water_v"):
        if netcdf.attributes(path, v).get("units") not in ("m/s", "m s-1"):
            raise quality.CheckError(f"{v} is not in m/s")
    rows = spark.read.format("marine_netcdf").options(path=path, variables="water_u,water_v").load()
    if [r.depth for r in rows.select("depth").distinct().limit(2).collect()] != [0.0]:
        raise quality.CheckError("more than the surface")
    times = rows.select("time").distinct()
    quality.require_hours(quality.require_times(times, day, 8, "time"), 3, "time")
    y, x = (F.dense_rank().over(Window.orderBy(c)) for c in ("lat", "lon"))
    places = rows.select("lat").distinct().withColumn("y", y), rows.select("lon").distinct().withColumn("x", x)  # the axes of one file
    rows = rows.join(F.broadcast(places[0]), "lat").join(F.broadcast(places[1]), "lon")
    return rows.select((F.hour("time") / 3).cast("int").alias("t"), "y", "x", "lat", "lon", F.col("water_u").alias("u"), F.col("water_v").alias("v")), []


def tide_stations(spark: SparkSession, cache: str, s: Settings, day: str, offline: bool = False) -> DataFrame:
    """(seed, provider, station, lat, lon, url) of the stations asked for; lat, lon and url are NULL where the inventory lacks one."""
    held, after = RequestCache(cache, offline), str(date.fromisoformat(day) + timedelta(days=1))
    known: dict[tuple[str, str], tuple] = {}
    if any(x.provider == "CHS" for x in s.tides):
        for x in held.json(f"{s.chs_base}/stations"):
            query = {"time-series-code": "wlp", "from": f"{day}T00:00:00Z", "to": f"{after}T00:00:00Z", "resolution": "SIXTY_MINUTES"}
            known["CHS", x["code"]] = float(x["latitude"]), float(x["longitude"]), canonical(f"{s.chs_base}/stations/{x['id']}/data", query)
    if any(x.provider == "NOAA" for x in s.tides):
        for x in held.json(f"{s.noaa_base}/mdapi/prod/webapi/stations.json", {"type": "tidepredictions"})["stations"]:
            query = {"product": "predictions", "station": x["id"], "begin_date": day.replace("-", ""), "end_date": day.replace("-", ""), "datum": "MLLW", "time_zone": "gmt", "interval": "h", "units": "metric", "format": "json"}
            known["NOAA", x["id"]] = float(x["lat"]), float(x["lng"]), canonical(f"{s.noaa_base}/api/prod/datagetter", query)
    rows = [(f"{x.provider}:{x.station}", x.provider, x.station, *known.get((x.provider, x.station), (None, None, None))) for x in s.tides]
    return spark.createDataFrame(rows, "seed string, provider string, station string, lat double, lon double, url string")


def tides(spark: SparkSession, cache: str, s: Settings, family: str, day: str, offline: bool = False) -> Layer:
    found = remote.stations(tide_stations(spark, cache, s, day, offline), cache, remote.water_levels, offline).cache()
    return found.where("error is null").select("seed", "ts", F.col("value").try_cast("double").alias("value")), remote.errors_of(found)


def river_discharge(spark: SparkSession, cache: str, s: Settings, family: str, day: str, offline: bool = False) -> Layer:
    """Daily means; a gauge without a record of the day has no row."""
    def url(g) -> str:
        if g.provider == "ECCC":
            return canonical(f"{s.eccc_base}/collections/hydrometric-daily-mean/items", {"f": "json", "STATION_NUMBER": g.station, "datetime": f"{day}/{day}", "limit": "1000"})
        return canonical(f"{s.usgs_base}/collections/daily/items", {"f": "json", "monitoring_location_id": g.station, "parameter_code": "00060", "statistic_id": "00003", "datetime": f"{day}/{day}", "limit": "1000"})

    asked = spark.createDataFrame([(f"{g.provider}:{g.station}", g.provider, g.station, url(g)) for g in s.rivers], "seed string, provider string, station string, url string")
    found = remote.stations(asked, cache, remote.daily_discharge, offline).cache()
    rows = found.where("error is null").select("seed", "station", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", "unit")
    return rows, remote.errors_of(found)


COLLECTED: dict[str, Callable[..., Layer]] = {"ocean_temperature": satellite, "productivity": satellite, "currents": currents, "offshore_currents": offshore_currents, "tides": tides, "river_discharge": river_discharge}


def collect(spark: SparkSession, layers: str, cache: str, settings: Settings, config_sha256: str, families: list[str], days: Callable[[str], list[str]], publish: Callable, offline: bool = False) -> list[dict]:
    """Publishes the layers of families and days; gives for each its errors, and why there is none if there is none."""
    prepare(spark)
    told = []
    for family in (f for f in families if f in COLLECTED):
        for day in days(family):
            try:
                rows, errors = COLLECTED[family](spark, cache, settings, family, day, offline)
                publish(rows, layers, family, day, config_sha256, settings.bbox.model_dump(), errors)
                told.append({"family": family, "day": day, "errors": errors, "failed": None})
            except (*remote.FAILURES, PySparkException) as e:
                told.append({"family": family, "day": day, "errors": [], "failed": str(e).split("\n")[0]})
    return told
