"""Polygons in GeoParquet files (S16): metadata from the footer, row groups skipped by their bounding boxes, projection into a zone."""

from __future__ import annotations

import json

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..sinks.store import files_of, opened


def metadata(path: str) -> dict:
    """The ``geo`` entry of a file's footer."""
    with opened(path) as f:
        held = pq.ParquetFile(f).schema_arrow.metadata or {}
    if b"geo" not in held:
        raise ValueError(f"{path} is no GeoParquet file")
    return json.loads(held[b"geo"])


def _nested(path: list[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def polygons(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, zone: int | None = None) -> DataFrame:
    """Rows of a GeoParquet file or folder with their primary geometry as ``wkb``: in degrees, or in a zone's metres.

    ``box`` (west, south, east, north) keeps what may touch it: the file's bounding box columns are filtered, which Parquet's statistics turn into row groups that
    are not read. Geometries in other systems than longitude and latitude, other encodings than WKB and files that tell different things are an error.
    """
    files = sorted(r.path for r in files_of(spark, path).select("path").collect()) if not path.endswith(".parquet") else [path]  # footers are read here, one a file
    told = [metadata(f) for f in files]
    name = told[0]["primary_column"]
    own = told[0]["columns"][name]
    if any(t["primary_column"] != name or t["columns"][name].get("covering") != own.get("covering") for t in told):
        raise ValueError(f"the files below {path} tell different geometries")
    if own["encoding"] != "WKB":
        raise ValueError(f"encoding {own['encoding']} is not read")
    crs = own.get("crs", {"id": {"authority": "OGC", "code": "CRS84"}})  # absent: longitude and latitude
    if (crs or {}).get("id", {}).get("code") not in ("CRS84", 4326, "4326"):
        raise ValueError("only longitudes and latitudes are read")
    rows = spark.read.parquet(path)
    if box is not None:
        west, south, east, north = box
        covering = own.get("covering", {}).get("bbox")
        if covering is None:
            raise ValueError("the file tells no bounding boxes")
        rows = rows.where((_nested(covering["xmin"]) <= east) & (_nested(covering["xmax"]) >= west) & (_nested(covering["ymin"]) <= north) & (_nested(covering["ymax"]) >= south))
    rows = rows.withColumnRenamed(name, "wkb")
    return rows if zone is None else rows.withColumn("wkb", geometry.projected("wkb", zone))
