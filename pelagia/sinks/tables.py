"""Feature tables, manifests and reports (K1-K3, K6-K8, L1-L3, P21, P22, R1-R3, F25, A.13)."""

from __future__ import annotations

import hashlib
import html
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import any_present
from ..operators.spatial import coverage
from . import store

DIAGNOSTICS = ("INPUT_PIXEL_COUNT", "EXPECTED_", "AVAILABLE_", "SOURCE_", "MEAN_EXPECTED", "MEAN_AVAILABLE", "MEAN_SOURCE", "MEAN_NEAREST", "SUPPORTED_", "COMPOSITE_")


def metric_columns(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    """By prefix, without counts of pixels."""
    return [c for c in df.columns if c.startswith(prefixes) and not c.endswith("_VALID_PIXELS") and not c.startswith(DIAGNOSTICS)]


def decorate(df: DataFrame, family: str, day: str, resolution: int, metrics: list[str], resolution_name: str = "H3_RESOLUTION") -> DataFrame:
    """A.13: the columns that all feature tables share."""
    return df.withColumns({"family": F.lit(family), "DATE": F.lit(day), resolution_name: F.lit(resolution), "AVAILABILITY_MODE": F.lit("retrospective"),
                           "AVAILABLE_AT_UTC": F.lit(None).cast("timestamp"), "FEATURE_STATUS": any_present(*(F.col(m) for m in metrics))})


def write_features(df: DataFrame, path: str, cell: str = "H3_INDEX") -> None:
    """K3, K6: replaces the (family, DATE) partitions that ``df`` holds and no others, in ranges of cells: a day of many cells is several tasks and files, a small one is one."""
    (df.repartitionByRange("family", "DATE", cell).sortWithinPartitions("family", "DATE", cell).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("family", "DATE").parquet(path))


def digest(paths: list[Path]) -> str:
    """Of files in name order: a partition's checksum (V7, L1)."""
    h = hashlib.sha256()
    for p in sorted(paths):
        h.update(p.name.encode())
        h.update(hashlib.sha256(p.read_bytes()).digest())
    return h.hexdigest()


def table_digest(df: DataFrame) -> str:
    """L1: of a table's rows, whatever their order and files."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{sorted(df.columns)} {r.n} {r.s}".encode()).hexdigest()


def code_digest() -> str:
    """L1: of this package's modules."""
    return digest([p for p in Path(__file__).parents[1].rglob("*.py") if "llm" not in p.parts])


def write_manifest(path: str, features: DataFrame, metrics: list[str], area: str, **lineage) -> dict:
    """Coverage and lineage of one partition, after the data: a reader that finds it finds the data too."""
    found = [r.asDict() for r in coverage(features, metrics, area).collect()]  # one row a metric
    value = {"coverage": found, "lookahead": False, **lineage}
    store.write_json(features.sparkSession, path, value)
    return value


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><select id="metric"></select><svg id="map" width="600" height="600"></svg><table id="rows"></table>
<script>const data={payload};const s=document.getElementById("metric"),t=document.getElementById("rows"),map=document.getElementById("map"),put=data.rows.filter(r=>r.lat!=null);
for(const m of data.metrics){{const o=document.createElement("option");o.textContent=m;s.append(o)}}
const xs=put.map(r=>r.lon*Math.cos(r.lat*Math.PI/180)),ys=put.map(r=>-r.lat),edge=Math.max(Math.max(...xs)-Math.min(...xs),Math.max(...ys)-Math.min(...ys))||1;
if(put.length)map.setAttribute("viewBox",[Math.min(...xs)-edge/20,Math.min(...ys)-edge/20,edge*1.1,edge*1.1].join(" "));else map.remove();
function draw(){{const m=s.value,[a,b]=data.ranges[m],log=a>=0&&b>50*Math.max(a,1e-9);
const f=x=>log?Math.log1p(x):x,k=r=>r[m]==null?null:(f(r[m])-f(a))/((f(b)-f(a))||1),colour=r=>k(r)==null?"#ccc":`hsl(${{220-220*k(r)}} 70% 75%)`;
t.replaceChildren(...data.rows.map(r=>{{const e=document.createElement("tr");
for(const x of [r.cell,r[m]??"missing"]){{const d=document.createElement("td");d.textContent=x;e.append(d)}}
e.style.background=colour(r);return e}}));
map.replaceChildren(...put.map((r,n)=>{{const c=document.createElementNS("http://www.w3.org/2000/svg","circle");c.setAttribute("cx",xs[n]);c.setAttribute("cy",ys[n]);c.setAttribute("r",edge/(2*Math.sqrt(put.length)+2));c.setAttribute("fill",colour(r));
const h=document.createElementNS("http://www.w3.org/2000/svg","title");h.textContent=`${{r.cell}}: ${{r[m]??"missing"}}`;c.append(h);return c}}))}}s.onchange=draw;draw()</script>"""


def report(df: DataFrame, folder: str, title: str, metrics: list[str]) -> int:
    """A page a day of a table (cell, day, metrics and, for a map, lat and lon), each written by the task that holds the day's rows, and an index
    of the pages; gives their number. Colours follow each metric's range over all days."""
    spark, shown = df.sparkSession, sorted(metrics)
    places = [c for c in ("lat", "lon") if c in df.columns]
    days = df.select(F.col("cell").cast("string").alias("cell"), F.col("day").cast("string").alias("day"), *places, *shown)
    ends = days.agg(*(f(m).alias(f"{name}{m}") for m in shown for name, f in (("low ", F.min), ("high ", F.max)))).first().asDict()
    ranges = {m: [ends[f"low {m}"], ends[f"high {m}"]] for m in shown}
    name = lambda day: f"{title}-{day}.html"

    def page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = rows.sort_values("cell").astype(object).where(rows.sort_values("cell").notna(), None)
        payload = json.dumps({"metrics": shown, "ranges": ranges, "rows": kept.to_dict("records")}, allow_nan=False, default=str).replace("<", "\\u003c")
        return pd.DataFrame({"day": [key[0]], "value": [PAGE.format(title=html.escape(f"{title}, {key[0]}"), payload=payload)]})

    pages = days.groupBy("day").applyInPandas(page, "day string, value string")
    pages.repartition("day").write.mode("overwrite").partitionBy("day").text(f"{folder}/{title}.pages")
    told = sorted(r.day for r in days.select("day").distinct().collect())  # a row a day
    for day in told:
        store.move_only_file(spark, f"{folder}/{title}.pages/day={day}", f"{folder}/{name(day)}")
    links = "".join(f'<li><a href="{html.escape(name(day))}">{html.escape(day)}</a>' for day in told)
    store.write_text(spark, f"{folder}/{title}.html", f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{links}</ul>')
    return len(told)


def catalog(features: DataFrame, descriptions: dict[str, str]) -> list[dict]:
    """R2, K8."""
    kinds = dict(features.dtypes)
    return [{"name": c, "type": kinds[c], "description": descriptions.get(c, "")} for c in sorted(kinds)]
