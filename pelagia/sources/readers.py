"""Readers that turn provider files into long rows."""

from __future__ import annotations

import io
import json
import math
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sinks.store import opened

CONSTITUENTS = ("M2", "S2", "N2", "K2", "K1", "O1", "P1", "Q1")


def erddap_attributes(info: dict) -> dict[tuple[str, str], str]:
    """(variable, attribute) -> value of an ERDDAP info table."""
    names = info["table"]["columnNames"]
    rows = (dict(zip(names, r, strict=True)) for r in info["table"]["rows"])
    return {(r["Variable Name"], r["Attribute Name"]): r["Value"] for r in rows if r["Row Type"] == "attribute"}


def griddap_query(variable: str, day: str, bbox: tuple[float, float, float, float], altitude: bool = False, quality: str | None = None) -> str:
    """The subset at noon of a day; bbox: west, south, east, north."""
    west, south, east, north = bbox
    at = f"[({day}T12:00:00Z)]{'[(0.0)]' if altitude else ''}[({north}):({south})][({west}):({east})]"
    return ",".join(f"{v}{at}" for v in filter(None, (variable, quality)))


class GridSource(DataSource):
    """Format ``marine_grid``: long rows of ERDDAP table files. Options: path (JSON files, comma-separated), variables, west, south, east, north, step (hours)."""

    @classmethod
    def name(cls) -> str:
        return "marine_grid"

    def schema(self) -> str:
        return "time string, lat double, lon double, " + ", ".join(f"{v.strip()} double" for v in self.options["variables"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return GridReader(dict(self.options))


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.variables = [v.strip() for v in options["variables"].split(",")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.strip()) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        box = [float(self.options.get(k, d)) for k, d in (("west", -360), ("south", -90), ("east", 360), ("north", 90))]
        step = int(self.options.get("step", 1))
        with opened(partition.value) as f:
            table = json.loads(f.read())["table"]
        at = {n: k for k, n in enumerate(table["columnNames"])}
        for r in table["rows"]:
            t, lat, lon = r[at["time"]], r[at["latitude"]], r[at["longitude"]]
            if box[1] <= lat <= box[3] and box[0] <= lon <= box[2] and int(t[11:13]) % step == 0:
                values = (r[at[v]] for v in self.variables)
                yield (t, float(lat), float(lon), *(None if v is None or math.isnan(v) else float(v) for v in values))


def features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Features of GeoJSON pages as rows."""
    kind = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates array<double>>>>".replace("struct<properties ", "struct<properties:").replace(", geometry ", ",geometry:").replace("struct<type ", "struct<type:").replace(", coordinates ", ",coordinates:")
    pages = spark.read.option("multiLine", True).schema(kind).json(paths)
    return pages.select(F.explode("features").alias("f")).select("f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def require_span(dataset_xml: str, day: str) -> None:
    """A subset service's time span must hold the day."""
    span = ET.fromstring(dataset_xml).find(".//TimeSpan")
    low, high = (date.fromisoformat(span.findtext(x)[:10]) for x in ("begin", "end"))
    if not low <= date.fromisoformat(day) <= high:
        raise ValueError(f"{day} is not in {low}..{high}")


END_RECORD = b"PK\x05\x06"


def embedded_zip(content: bytes, member: str) -> bytes:
    """A member of a ZIP archive inside a larger file, which is never run. The end record's comment length must close it."""
    at = content.find(END_RECORD)
    while at >= 0:
        if at + 22 <= len(content):
            end = at + 22 + struct.unpack_from("<H", content, at + 20)[0]
            try:
                with zipfile.ZipFile(io.BytesIO(content[:end])) as z:
                    found = [n for n in z.namelist() if n.rsplit("/", 1)[-1] == member]
                    if len(found) == 1:
                        return z.read(found[0])
                    if len(found) > 1:
                        raise ValueError(f"{member} is there more than once")
            except zipfile.BadZipFile:
                pass
        at = content.find(END_RECORD, at + 4)
    raise ValueError(f"no archive with {member}")


def mesh_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Id, longitude and latitude a line."""
    x = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(x[0].cast("int").alias("node"), x[1].cast("double").alias("lon"), x[2].cast("double").alias("lat"))


def mesh_elements(spark: SparkSession, path: str) -> DataFrame:
    """Id and three node ids, counted from 1."""
    x = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(x[0].cast("int").alias("tri"), *(x[k + 1].cast("int").alias(f"n{k}") for k in range(3)))


def constituent(spark: SparkSession, path: str, name: str, header: int = 3) -> DataFrame:
    """Node, amplitude and phase a line below a header; as re and im."""
    from ..operators.harmonics import from_polar

    x = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(x) == header).select(x[0].cast("int").alias("node"), x[1].cast("double").alias("a"), x[2].cast("double").alias("g"))
    re, im = from_polar(F.col("a"), F.col("g"))
    return rows.select("node", F.lit(name).alias("constituent"), re.alias("re"), im.alias("im"))


def require_sequence(rows: DataFrame, column: str) -> DataFrame:
    """Ids 1, 2, ..., n."""
    r = rows.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.countDistinct(column).alias("d")).first()
    if not r.n or (r.low, r.high, r.d) != (1, r.n, r.n):
        raise ValueError(f"{column} is no sequence")
    return rows


def partitions(spark: SparkSession, root: str, family: str, start: str, end: str) -> tuple[DataFrame, list[str]]:
    """The family's feature rows of a date range (partition pruning), and the dates that have no partition."""
    rows = spark.read.parquet(root).where((F.col("family") == family) & F.col("DATE").between(start, end))
    have = {str(r[0]) for r in rows.select("DATE").distinct().collect()}
    want = [str(r[0]) for r in spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end))))).collect()]
    return rows, [d for d in want if d not in have]
