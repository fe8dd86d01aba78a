"""Daily families from long-form layers to feature tables (A.1-A.9, P27, P28, V15, L3)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, masks, units
from ..operators import grid, harmonics, kernel, quality, rosters, spatial, trailing
from ..operators import tides as tides_of
from ..operators import water as water_graph
from ..sources.config import Settings

FAMILIES = ("tides", "river_discharge", "currents", "ocean_temperature", "productivity", "offshore_currents", "tidal_model")


def days_of(family: str, start: str, end: str, window: int = 7) -> list[str]:
    """Productivity looks back over its window."""
    first = date.fromisoformat(start) - timedelta(days=window - 1 if family == "productivity" else 0)
    return [str(first + timedelta(days=k)) for k in range((date.fromisoformat(end) - first).days + 1)]


def water(support: DataFrame) -> DataFrame:
    """P8, where the support tells which cells touch water."""
    return spatial.wet(support) if "has_water_overlap" in support.columns else support


def ocean_temperature(pixels: DataFrame, support: DataFrame, index: Callable[[Column, Column], Column], least_quality: int = 4) -> DataFrame:
    """pixels: lat, lon, sst, quality."""
    support = water(support)
    sst = masks.physical(masks.quality_band(masks.present(F.col("sst")), F.col("quality"), least_quality))
    layer = pixels.select("lat", "lon", sst.alias("SST_MEAN_C"), index(F.col("lat"), F.col("lon")).alias("cell"))
    return spatial.aggregate_pixels(layer, support, ["SST_MEAN_C"])


def productivity(pixels: DataFrame, support: DataFrame, index: Callable[[Column, Column], Column]) -> DataFrame:
    """pixels: lat, lon, chlorophyll. The mean of logs is no log of the mean."""
    support = water(support)
    x = masks.positive(masks.present(F.col("chlorophyll")))
    layer = pixels.select("lat", "lon", x.alias("CHLOROPHYLL_MEAN_MG_M3"), F.ln(x).alias("CHLOROPHYLL_LOG_MEAN"), index(F.col("lat"), F.col("lon")).alias("cell"))
    return spatial.aggregate_pixels(layer, support, ["CHLOROPHYLL_MEAN_MG_M3", "CHLOROPHYLL_LOG_MEAN"])


def productivity_composite(daily: DataFrame, support: DataFrame, days: DataFrame, window: int = 7, minimum: int = 1) -> DataFrame:
    return trailing.trailing_composite(daily, trailing.spine(support.select("cell"), days), "cell", "day", "CHLOROPHYLL_MEAN_MG_M3", window, minimum)


def currents(raster: DataFrame, support: DataFrame, index: Callable[[Column, Column], Column], interval_hours: int = 4) -> DataFrame:
    """raster: t, y, x, lat, lon, u, v, depth; a repeated place (V10) is an error."""
    quality.require_unique(raster, ["t", "y", "x"])
    u, v = masks.magnitude(masks.present(F.col("u"))), masks.magnitude(masks.present(F.col("v")))
    speed = grid.collocated_speed(raster.withColumns({"u": u, "v": v}), wet=F.col("depth") > 0)
    return _speeds(speed, support, index, 24 // interval_hours, "CURRENT_SPEED_SAMPLE_MEAN_MS", "CURRENT_SPEED_SAMPLE_MAX_MEAN_MS")


def offshore_currents(samples: DataFrame, support: DataFrame, index: Callable[[Column, Column], Column]) -> DataFrame:
    """samples: t, y, x, lat, lon, u, v at eight three-hourly times (V2)."""
    quality.require_hours(samples.select(F.timestamp_seconds(F.col("t") * 10800).alias("ts")))
    speed = samples.withColumn("speed", F.hypot(masks.present(F.col("u")), masks.present(F.col("v")))).withColumn("lon", masks.longitude_180(F.col("lon")))
    return _speeds(speed, support, index, 8, "OFFSHORE_CURRENT_SPEED_SAMPLE_MEAN_MS", "OFFSHORE_CURRENT_SPEED_SAMPLE_MAX_MEAN_MS")


def _speeds(speed: DataFrame, support: DataFrame, index, expected: int, mean: str, most: str) -> DataFrame:
    full = grid.complete_samples(speed, ["y", "x", "lat", "lon"], "speed", expected)
    layer = full.select("lat", "lon", F.col("sample_mean").alias(mean), F.col("sample_max").alias(most), index(F.col("lat"), F.col("lon")).alias("cell"))
    return spatial.aggregate_pixels(layer, support, [mean, most]).withColumn("EXPECTED_TIME_SAMPLES", F.lit(expected))


def influence_features(fine: DataFrame, coarse: DataFrame, distances: DataFrame, values: DataFrame, prefix: str, scales: list[float], parent: Callable[[Column], Column], cutoff: float = 3.0, normalize: bool = False) -> DataFrame:
    """A.7, A.8: kernels on the fine cells (cell, area), rolled up to the coarse ones (cell). Distances are computed once for all days."""
    out = coarse
    for scale in scales:
        name = masks.scale_name(prefix, scale)
        near = kernel.influence_on(fine, distances, values, scale, cutoff, normalize).withColumn("parent", parent(F.col("cell")))
        up = spatial.gated_roll_up(near, "parent", "value", missing_source=F.col("available_sources") < F.col("expected_sources"), diagnostics=("expected_sources", "available_sources", "source_completeness", "nearest_source"))
        own = up.select(F.col("parent").alias("cell"), F.col("value").alias(name), F.col("supported_fraction").alias(masks.scale_name("SUPPORTED_WATER_FRACTION", scale)), *(
            F.col(f"mean_{a}").alias(masks.scale_name(b, scale)) for a, b in (("expected_sources", "MEAN_EXPECTED_SOURCES"), ("available_sources", "MEAN_AVAILABLE_SOURCES"), ("source_completeness", "MEAN_SOURCE_COMPLETENESS"), ("nearest_source", "MEAN_NEAREST_SOURCE_WATER_KM"))))
        out = out.join(own, "cell", "left")
    return out


def tides(samples: DataFrame, day: str, fine: DataFrame, coarse: DataFrame, distances: DataFrame, scales: list[float], minimum: int, parent: Callable[[Column], Column], cutoff: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """A.4, A.7, A.8: (features, stations). samples: seed, ts, value; the weighted mean of the stations' daily ranges."""
    own = quality.require_unique(grid.on_day(samples, day), ["seed", "ts"])
    stations = grid.station_range(own.withColumn("value", masks.present(F.col("value"))), ["seed"], "value", minimum)
    stations = samples.select("seed").distinct().join(stations, "seed", "left").fillna(0, ["sample_count"])
    values = stations.select("seed", F.col("value_range").alias("value"))
    return influence_features(fine, coarse, distances, values, "TIDE_RANGE_PROXY_M", scales, parent, cutoff, normalize=True), stations.withColumnRenamed("value_range", "TIDE_HOURLY_RANGE_M")


def river_discharge(records: DataFrame, gauges: DataFrame, day: str, fine: DataFrame, coarse: DataFrame, distances: DataFrame, scales: list[float], parent: Callable[[Column], Column], cutoff: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """A.5, A.7, A.8: (features, stations). records: seed, station, day, value (text), unit; gauges: seed, gauge. A gauge without a record has no value."""
    value = units.discharge_m3_s(units.checked(units.number(F.col("value")), station=(F.col("station"), F.col("gauge")), day=(F.col("day").cast("string"), F.lit(day))), F.col("unit"))
    own = records.join(gauges, "seed").select("seed", value.alias("DISCHARGE_M3_S"))
    stations = rosters.roster_values(gauges, own, ["seed"])
    values = stations.select("seed", F.col("DISCHARGE_M3_S").alias("value"))
    return influence_features(fine, coarse, distances, values, "RIVER_DISCHARGE_INFLUENCE_M3_S", scales, parent, cutoff), stations


def tidal_model(points: DataFrame, nodes: DataFrame, elements: DataFrame, constituents: DataFrame, day: str, support: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A.10, A.11: (features, heights). points: cell, lat, lon; the daily range of 24 predicted hours on every cell of the support."""
    if not constituents.join(nodes, "node", "left_anti").isEmpty():  # V12
        raise quality.CheckError("a constituent has nodes that the mesh lacks")
    at = harmonics.interpolate(points.withColumnRenamed("cell", "point"), nodes, elements, constituents)
    hours = tides_of.hours_of(points.sparkSession, day)
    places = points.select(F.col("cell").alias("point"), "lat")
    heights = tides_of.heights(at.drop("triangle").join(places, "point"), hours.select("ts")).join(F.broadcast(hours), "ts").select("point", "hour", "height")
    where = at.groupBy("point").agg(F.min("triangle").alias("NATIVE_TRIANGLE"))
    ranges = where.join(harmonics.daily_range(heights), "point", "left").select(F.col("point").alias("cell"), "NATIVE_TRIANGLE", F.col("hourly_range").alias("HARMONIC_TIDE_HOURLY_RANGE_M"))
    return support.join(ranges, "cell", "left"), heights


def seed_distances(seeds: DataFrame, polygon: DataFrame, support: DataFrame, edges: DataFrame, settings: Settings, block: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """A.6: (distances, mapping) of seeds (seed, kind, lat, lon) over the water graph.

    polygon: one row, the water in degrees (wkb). support: cells with lat, lon, eligible, degree and, for terminal cells, connection = 'terminal_connector', connector_target and connector_m.
    edges: source, target, distance_m, passable. A river's mouth may lie farther from the water than a tide station. A seed that can't be mapped has no distances.
    """
    box = settings.bbox
    water_here = F.broadcast(polygon.limit(1).select(geometry.projected(geometry.clipped("wkb", (box.west - 0.1, box.south - 0.1, box.east + 0.1, box.north + 0.1))).alias("water")))  # one row
    place = lambda df: df.withColumns(dict(zip(("x", "y"), water_graph.utm10(F.col("lon"), F.col("lat")), strict=True)))
    limit = F.when(F.col("kind") == "river_mouth", settings.mouth_coast_snap_max_m).otherwise(settings.tide_coast_snap_max_m).cast("double")
    placed = place(seeds).select("seed", "x", "y", limit.alias("coast_limit_m"))
    nodes = place(water_graph.graph_nodes(support)).select("cell", "x", "y")
    mapping = water_graph.snap_seeds(placed, nodes, placed.select("seed").join(water_here), settings.seed_snap_max_km, settings.seed_shore_tolerance_m)
    terminal = support.where("connection = 'terminal_connector' and connector_target is not null").select("cell", F.col("connector_target").alias("target"), (F.col("connector_m") / 1000).alias("connector_km"))
    starts = mapping.where("status = 'mapped'").select("seed", "cell", "connector_km")
    return water_graph.water_distances(water_graph.canonical_edges(edges, support), starts, terminal, block=block), mapping


def contained(build: Callable[[], DataFrame], support: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, str | None]:
    """A family that fails gives its support with NULLs, and the reason."""
    try:
        return build(), None
    except (ValueError, KeyError, OSError, PySparkException) as e:
        return support.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()}), str(e)
