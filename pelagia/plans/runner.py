"""From daily layers to feature tables, manifests, comparison and reports (S18, K1, K2, V7, V8, L1-L3, U7, R2, R4, section 3.2).

``<layers>/<family>/DATE=<day>`` is what was collected (long-form Parquet, published with a manifest), ``<out>/<family>`` the
features, ``<out>/layers`` and ``<out>/stations`` what lies between. Each (family, day) is built, written as its own partition and
told by a manifest after the data; a family that fails, while it is planned or while it runs, gives a partition of NULLs.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, masks
from ..operators import comparison, harmonics, quality, tides, trailing
from ..operators.spatial import gated_roll_up
from ..sinks import store, tables
from ..sources import config
from . import collect as collecting
from . import families

Index = Callable[[Column, Column], Column]


@dataclass
class Region:
    """What does not change from day to day. support: (cell, area) by resolution; fixed: tables of the station and mesh families by name."""

    support: dict[int, DataFrame]
    fixed: dict[str, DataFrame] = field(default_factory=dict)
    settings: config.Settings = field(default_factory=config.Settings)
    cells: str = "h3"

    def index(self, res: int) -> Index:
        return cells.indexer(res, self.cells)

    @property
    def cell_name(self) -> str:
        """Only ids of H3 are called so."""
        return "H3_INDEX" if self.cells == "h3" else "GRID_INDEX"


@dataclass
class Family:
    """``make(layer, region, day)`` gives the features and, for station families, the stations."""

    make: Callable[[DataFrame, Region, str], tuple[DataFrame, DataFrame | None]]
    resolution: int
    metrics: Callable[[config.Settings], list[str]]
    collected: bool = True  # a model needs no layer of the day


def _raster(f: Callable, res: int, *metrics: str) -> Family:
    return Family(lambda layer, region, day: (f(layer, region.support[res], region.index(res)), None), res, lambda settings: list(metrics))


def _parent(c: Column) -> Column:
    return cells.parent(c, 8, 6)


def _tides(layer: DataFrame, region: Region, day: str) -> tuple[DataFrame, DataFrame]:
    s = region.settings
    return families.tides(layer, day, region.support[8], region.support[6], region.fixed["tide_distances"], s.tide_decay_km, s.min_tide_samples, _parent, s.kernel_cutoff_multiples)


def _rivers(layer: DataFrame, region: Region, day: str) -> tuple[DataFrame, DataFrame]:
    s = region.settings
    return families.river_discharge(layer, region.fixed["gauges"], day, region.support[8], region.support[6], region.fixed["river_distances"], s.river_decay_km, _parent, s.kernel_cutoff_multiples)


def _tidal_model(layer: None, region: Region, day: str) -> tuple[DataFrame, DataFrame]:
    f = region.fixed
    made, heights = families.tidal_model(f["points"], f["mesh_nodes"], f["mesh_elements"], f["constituents"], day, region.support[6])
    return made, heights.withColumnRenamed("point", "cell")


FAMILIES: dict[str, Family] = {
    "ocean_temperature": _raster(families.ocean_temperature, 6, "SST_MEAN_C"),
    "productivity": _raster(families.productivity, 5, "CHLOROPHYLL_MEAN_MG_M3", "CHLOROPHYLL_LOG_MEAN"),
    "currents": _raster(families.currents, 6, "CURRENT_SPEED_SAMPLE_MEAN_MS", "CURRENT_SPEED_SAMPLE_MAX_MEAN_MS"),
    "offshore_currents": _raster(families.offshore_currents, 5, "OFFSHORE_CURRENT_SPEED_SAMPLE_MEAN_MS", "OFFSHORE_CURRENT_SPEED_SAMPLE_MAX_MEAN_MS"),
    "tides": Family(_tides, 6, lambda s: [masks.scale_name("TIDE_RANGE_PROXY_M", x) for x in s.tide_decay_km]),
    "river_discharge": Family(_rivers, 6, lambda s: [masks.scale_name("RIVER_DISCHARGE_INFLUENCE_M3_S", x) for x in s.river_decay_km]),
    "tidal_model": Family(_tidal_model, 6, lambda s: ["HARMONIC_TIDE_HOURLY_RANGE_M"], collected=False),
}
#: A comparison needs all of these.
COMPARED = ("tides", "currents", "tidal_model", "offshore_currents", "productivity")


def publish_layer(rows: DataFrame, layers: str, family: str, day: str, config_sha256: str, bbox: dict, errors: list[str] | None = None) -> None:
    """K1: what was collected for a day, then its manifest."""
    rows.write.mode("overwrite").parquet(f"{layers}/{family}/DATE={day}")
    store.write_json(rows.sparkSession, manifest(layers, family, day), {"family": family, "day": day, "config_sha256": config_sha256, "bbox": bbox, "errors": errors or [],
                                                                        "sha256": store.folder_digest(rows.sparkSession, f"{layers}/{family}/DATE={day}")})


def collected(spark: SparkSession, layers: str, family: str, day: str, config_sha256: str | None, bbox: dict) -> tuple[DataFrame, dict]:
    """A day's layer and manifest, if they belong together and to this configuration."""
    if not store.exists(spark, manifest(layers, family, day)):
        raise OSError(f"no layer of {family} on {day}")
    told = store.read_json(spark, manifest(layers, family, day))
    if told["bbox"] != bbox:
        raise quality.CheckError("collected for another area")
    if config_sha256 is not None and told["config_sha256"] != config_sha256:
        raise quality.CheckError("collected under another configuration")
    if told["sha256"] != store.folder_digest(spark, f"{layers}/{family}/DATE={day}"):
        raise quality.CheckError("the layer is not what was published")
    try:
        return spark.read.parquet(f"{layers}/{family}/DATE={day}"), told
    except AnalysisException as e:
        raise OSError(f"no layer of {family} on {day}") from e


def manifest(root: str, family: str, day: str) -> str:
    """Manifests lie beside the data, in whatever store that is."""
    return f"{root}/manifests/{family}-{day}.json"


def partition(out: str, family: str, day: str) -> str:
    return f"{out}/{family}/family={family}/DATE={day}"


def verified(spark: SparkSession, out: str, family: str, days: list[str]) -> DataFrame:
    """V7: a family's features, if each day's files are those that its manifest tells of."""
    for day in days:
        told = store.read_json(spark, manifest(out, family, day))
        if told["feature_sha256"] != store.folder_digest(spark, partition(out, family, day)):
            raise quality.CheckError(f"features of {family} on {day} are not those of the manifest")
    return spark.read.parquet(f"{out}/{family}").where(F.col("DATE").cast("string").isin(days))


def build(spark: SparkSession, layers: str, region: Region, out: str, start: str, end: str, wanted: tuple[str, ...] = tuple(FAMILIES), config_sha256: str = "") -> list[dict]:
    """Manifests of all (family, day) built: available, partial (the source told errors) or unavailable."""
    quality.require_interval(start, end)
    if unknown := sorted(set(wanted) - set(FAMILIES)):
        raise quality.CheckError(f"unknown families: {unknown}")
    if {"tides", "river_discharge"} & set(wanted):
        region = with_distances(spark, region, out)
    lineage = {"code_sha256": tables.code_digest(), "support_sha256": {str(r): tables.table_digest(s) for r, s in region.support.items()}, "config_sha256": config_sha256}
    told = []
    for family in wanted:
        kind, metrics = FAMILIES[family], FAMILIES[family].metrics(region.settings)
        support = region.support[kind.resolution]

        def written(rows: DataFrame, day: str) -> None:
            named = rows.withColumns({region.cell_name: cells.to_text(F.col("cell")), "WATER_AREA_M2": F.col("area")})  # noqa: B023
            done = tables.decorate(named, family, day, kind.resolution, metrics, region.cell_name.replace("INDEX", "RESOLUTION"))  # noqa: B023
            tables.write_features(done, f"{out}/{family}", region.cell_name)  # noqa: B023

        def make(day: str) -> tuple[DataFrame, list]:
            layer, source = collected(spark, layers, family, day, config_sha256, region.settings.bbox.model_dump()) if kind.collected else (None, {"errors": []})  # noqa: B023
            rows, stations = kind.make(layer, region, day)  # noqa: B023
            if stations is not None:  # K2
                stations.write.mode("overwrite").parquet(f"{out}/stations/{family}/DATE={day}")  # noqa: B023
            written(rows, day)
            return rows, source["errors"]

        for day in families.days_of(family, start, end):
            errors: list[str] = []

            def attempt(day: str = day, errors: list[str] = errors) -> DataFrame:
                rows, found = make(day)  # noqa: B023
                errors += found
                return rows

            rows, why = families.contained(attempt, support, dict.fromkeys(metrics, "double"))
            if why:
                written(rows, day)
            status = "unavailable" if why else "partial" if errors else "available"
            told.append(tables.write_manifest(manifest(out, family, day), spark.read.parquet(partition(out, family, day)), metrics, "area", family=family, day=day, status=status, error=why,
                                              source_errors=errors, feature_sha256=store.folder_digest(spark, partition(out, family, day)), **lineage))
    if "productivity" in wanted:
        told += composites(spark, out, families.water(region.support[5]), start, end, region.settings.productivity_window_days, region.settings.productivity_min_valid_days)
    return told


def with_distances(spark: SparkSession, region: Region, out: str) -> Region:
    """A.6 once for all days: where the region holds ``seeds``, ``water`` and ``edges`` but no distances, they are computed and written to ``<out>/distances``, with what became of each seed."""
    have = region.fixed
    lacking = [f"{k}_distances" for k in ("tide", "river") if f"{k}_distances" not in have]
    if not lacking or not {"seeds", "water", "edges"} <= set(have):
        return region
    block = (lambda c: cells.parent(c, 8, 3)) if region.cells == "h3" else None  # some 17,000 cells of resolution 8
    found, mapping = families.seed_distances(have["seeds"], have["water"], region.support[8], have["edges"], region.settings, block)
    told = mapping.join(have["seeds"].select("seed", "kind"), "seed")
    told.write.mode("overwrite").parquet(f"{out}/distances/mapping")
    found.join(F.broadcast(have["seeds"].select("seed", "kind")), "seed").write.mode("overwrite").partitionBy("kind").parquet(f"{out}/distances/ways")  # seeds: tens
    ways = spark.read.parquet(f"{out}/distances/ways")
    kinds = {"tide_distances": "kind <> 'river_mouth'", "river_distances": "kind = 'river_mouth'"}
    return replace(region, fixed=have | {name: ways.where(kinds[name]).drop("kind") for name in lacking})


def composites(spark: SparkSession, out: str, support: DataFrame, start: str, end: str, window: int = 7, minimum: int = 1) -> list[dict]:
    """Second pass: trailing columns of the days asked for, from verified look-back days that only feed them. Manifests tell which days were missing (L2, L3)."""
    first = families.days_of("productivity", start, start, window)[0]
    every = families.days_of("productivity", start, end, window)
    lost = [d for d in every if store.read_json(spark, manifest(out, "productivity", d))["status"] == "unavailable"]
    rows = verified(spark, out, "productivity", every)
    daily = rows.select("cell", F.to_date("DATE").alias("day"), "CHLOROPHYLL_MEAN_MG_M3")
    made = families.productivity_composite(daily, support, trailing.date_spine(spark, first, end), window, minimum).where(F.col("day") >= F.to_date(F.lit(start)))
    names = {"trailing_mean": "CHLOROPHYLL_TRAILING_7D_MEAN_MG_M3", "trailing_log_mean": "CHLOROPHYLL_TRAILING_7D_LOG_MEAN", "trailing_2plus_mean": "CHLOROPHYLL_TRAILING_7D_2PLUS_MEAN_MG_M3",
             "valid_days": "COMPOSITE_VALID_DAYS", "newest_age": "COMPOSITE_NEWEST_AGE_DAYS", "oldest_age": "COMPOSITE_OLDEST_AGE_DAYS", "window_days": "COMPOSITE_WINDOW_DAYS"}
    made = made.select("cell", F.date_format("day", "yyyy-MM-dd").alias("DATE"), *(F.col(a).alias(b) for a, b in names.items()))
    own = rows.where(F.col("DATE").between(start, end)).drop(*names.values()).withColumn("DATE", F.col("DATE").cast("string"))
    path = f"{out}/productivity_with_composites"
    tables.write_features(own.join(made, ["cell", "DATE"]), path, next(c for c in own.columns if c.endswith("_INDEX")))
    told = []
    for day in (d for d in every if d >= start):
        back = [d for d in lost if families.days_of("productivity", day, day, window)[0] <= d <= day]
        features = spark.read.parquet(f"{path}/family=productivity/DATE={day}")
        told.append(tables.write_manifest(manifest(out, "productivity_with_composites", day), features, ["CHLOROPHYLL_TRAILING_7D_MEAN_MG_M3"], "area", family="productivity_with_composites", day=day,
                                          status="partial" if back else "available", missing_days=back, feature_sha256=store.folder_digest(spark, f"{path}/family=productivity/DATE={day}")))
    return told


def compare_currents(fine: DataFrame, coarse: DataFrame, fine_value: str, coarse_value: str) -> DataFrame:
    """Regional cells rolled up to the broader resolution (gated at half the area), against the broader source, day by day."""
    up = fine.withColumn("__key", F.struct(cells.parent(F.col("cell"), 6, 5).alias("cell"), F.col("DATE")))
    up = gated_roll_up(up, "__key", fine_value).select("__key.cell", "__key.DATE", F.col(fine_value).alias("regional"))
    both = up.join(coarse.select("cell", "DATE", F.col(coarse_value).alias("broader")), ["cell", "DATE"])
    return comparison.agreement(both, ["DATE"], "regional", "broader")


def compare_tides(observed: DataFrame, heights: DataFrame, triangles: DataFrame) -> DataFrame:
    """R4, A.12: hourly predictions of the mesh against stations, day by day. observed: station, DATE, hour, value; heights: station, DATE, hour, height; triangles: station, DATE, triangle."""
    keys = ["station", "DATE"]
    hours = observed.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    spine = comparison.on_spine(hours, observed, keys).join(heights, [*keys, "hour"], "left")
    full = spine.groupBy(*keys).agg((F.count("value") == 24).alias("complete"))
    found = comparison.agreement(spine, keys, "value", "height")
    told = triangles.join(full, keys, "left").withColumn("status", comparison.station_status(F.col("triangle"), F.coalesce("complete", F.lit(False))))
    told = told.join(found, keys, "left")
    measures = ("n", "mae", "demeaned_rmse", "correlation", "range_error")
    return told.select(*keys, "triangle", "status", *(F.when(F.col("status") == "compared", F.col(c)).alias(c) for c in measures))


def tide_checks(observed: DataFrame, stations: DataFrame, region: Region, days: list[str]) -> DataFrame:
    """The mesh's predictions at the stations (seed, lat, lon) of all ``days`` against what was collected (seed, ts, value). No station is moved to a triangle."""
    spark, f = observed.sparkSession, region.fixed
    places = stations.select(F.col("seed").alias("point"), "lat", "lon")
    at = harmonics.interpolate(places, f["mesh_nodes"], f["mesh_elements"], f["constituents"])
    hours = reduce(DataFrame.unionByName, (tides.hours_of(spark, day).withColumn("DATE", F.lit(day)) for day in days))
    heights = tides.heights(at.drop("triangle").join(places.select("point", "lat"), "point"), hours.select("ts")).join(F.broadcast(hours), "ts").select(F.col("point").alias("station"), "DATE", "hour", "height")
    triangles = at.groupBy(F.col("point").alias("station")).agg(F.min("triangle").alias("triangle")).crossJoin(F.broadcast(hours.select("DATE").distinct()))  # days asked for
    own = observed.select(F.col("seed").alias("station"), F.date_format("ts", "yyyy-MM-dd").alias("DATE"), F.hour("ts").alias("hour"), masks.present(F.col("value")).alias("value"), F.minute("ts").alias("minute"))
    own = own.where(F.col("DATE").isin(days) & (F.col("minute") == 0)).drop("minute")
    return compare_tides(own, heights, triangles)


def source_coverage(fine: DataFrame, broader: DataFrame, fine_value: str, broader_value: str, fine_resolution: int = 6, broader_resolution: int = 6) -> DataFrame:
    """By day, shares of the area of ``fine`` (cell, DATE, area) that its own source, the broader one on the same day, or either covers."""
    if fine_resolution == broader_resolution:
        both = fine.join(broader.select("cell", "DATE", broader_value), ["cell", "DATE"], "left")
    else:
        both = comparison.with_parent_value(fine, broader, broader_value, fine_resolution, broader_resolution, ("DATE",))
    return comparison.complementary(both, F.col(fine_value).isNotNull(), F.col(broader_value).isNotNull(), keys=("DATE",))


def compare(spark: SparkSession, out: str, start: str, end: str, layers: str | None = None, region: Region | None = None) -> dict[str, list[dict]]:
    """Overlap of currents, coverage of both pairs of sources and, with the layers and the region, checks of the tidal model at the stations, over verified days; sources are never blended."""
    quality.require_interval(start, end)
    days = families.days_of("currents", start, end)
    if lacking := [f for f in COMPARED for d in days if not store.exists(spark, manifest(out, f, d))]:
        raise quality.CheckError(f"a comparison needs {sorted(set(lacking))} as well")
    read = {f: verified(spark, out, f, days).withColumn("DATE", F.col("DATE").cast("string")) for f in COMPARED}
    settings = region.settings if region else config.Settings()
    a, b = (FAMILIES[f].metrics(settings)[0] for f in ("currents", "offshore_currents"))
    tide = FAMILIES["tides"].metrics(settings)[-1]
    listed = lambda df, *keys: [r.asDict() for r in df.orderBy(*keys).collect()]  # noqa: E731  a row a day, or a day and station
    shares = [{"family": f, **r} for f, df in (("currents", source_coverage(read["currents"], read["offshore_currents"], a, b, 6, 5)), ("tides", source_coverage(read["tides"], read["tidal_model"], tide, "HARMONIC_TIDE_HOURLY_RANGE_M"))) for r in listed(df, "DATE")]
    ranges = read["tides"].select("cell", "DATE").join(read["tidal_model"].select("cell", "DATE", "HARMONIC_TIDE_HOURLY_RANGE_M"), ["cell", "DATE"])
    modelled = ranges.groupBy("DATE").agg(F.count("HARMONIC_TIDE_HOURLY_RANGE_M").alias("cells"), F.avg("HARMONIC_TIDE_HOURLY_RANGE_M").alias("mean_range_m"))
    found = {"currents": listed(compare_currents(read["currents"], read["offshore_currents"], a, b), "DATE"), "coverage": shares, "tidal_model": listed(modelled, "DATE"), "automatic_blending": False,
             "families": [{"family": f, "DATE": d, "coverage": store.read_json(spark, manifest(out, f, d))["coverage"]} for f in COMPARED for d in days]}
    if layers and region and "tide_stations" in region.fixed:
        observed = reduce(DataFrame.unionByName, (collected(spark, layers, "tides", d, None, region.settings.bbox.model_dump())[0] for d in days))
        found["tide_checks"] = listed(tide_checks(observed, region.fixed["tide_stations"], region, days), "DATE", "station")
    return found


def main(argv: list[str] | None = None) -> int:
    """``init`` writes a configuration that isn't there yet; ``collect``, ``build``, ``compare`` and ``inspect`` work on a workspace. 1 if a family failed."""
    p = argparse.ArgumentParser(prog="pelagia")
    p.add_argument("command", choices=("init", "collect", "build", "compare", "inspect"))
    p.add_argument("--workspace")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--families", nargs="*", default=list(FAMILIES))
    p.add_argument("--offline", action="store_true")
    p.add_argument("--cells", default="h3", choices=("h3", "grid"))
    a = p.parse_args(argv)
    root = config.workspace(a.workspace)
    if a.command == "init":
        config.initialize(root, {"pelagia.yaml": "area: model_area\n"})
        return 0
    document, settings = config.load(root / "pelagia.yaml")
    spark = SparkSession.builder.appName("pelagia").getOrCreate()
    out = str(root / settings.feature_dir)
    if a.command == "collect":
        quality.require_interval(a.start, a.end)
        told = collecting.collect(spark, str(root / "layers"), str(root / settings.cache_dir), settings, config.fingerprint(document), a.families, lambda f: families.days_of(f, a.start, a.end), publish_layer, a.offline)
        store.write_json(spark, f"{root}/collected.json", told)
        return int(any(t["failed"] for t in told))
    have = {p.name: spark.read.parquet(str(p)) for p in sorted((root / "support").iterdir())} if a.command in ("build", "compare") else {}
    region = Region({int(k[1:]): v for k, v in have.items() if k[:1] == "r" and k[1:].isdigit()}, {k: v for k, v in have.items() if not k[1:].isdigit()}, settings, a.cells)
    if a.command == "build":
        told = build(spark, str(root / "layers"), region, out, a.start, a.end, tuple(a.families), config.fingerprint(document))
        return int(any(m["status"] == "unavailable" for m in told))
    if a.command == "compare":
        store.write_json(spark, f"{root}/comparison.json", compare(spark, out, a.start, a.end, str(root / "layers"), region))
        return 0
    quality.require_interval(a.start, a.end, 31)
    for family in a.families:
        rows, metrics = verified(spark, out, family, families.days_of("", a.start, a.end)), FAMILIES[family].metrics(settings)
        index = next(c for c in rows.columns if c.endswith("_INDEX"))
        shown = rows.select(F.col(index).alias("cell"), F.col("DATE").alias("day"), *metrics, *([cells.hex_centre(F.col("cell")).alias("centre")] if index.startswith("H3") else []))
        shown = shown.select("cell", "day", *metrics, "centre.lat", "centre.lon") if "centre" in shown.columns else shown
        tables.report(shown, str(root), family, metrics)
        store.write_json(spark, f"{root}/{family}.catalog.json", tables.catalog(rows, {m: f"{family}, resolution {FAMILIES[family].resolution}" for m in metrics}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
