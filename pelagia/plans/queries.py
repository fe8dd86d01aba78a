"""Operators on the driver's tables, each beside SQL that DuckDB runs on the same tables.

Doubles are rounded after a shift off rounding ties, on both sides alike.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, hexagons, masks, units
from ..operators import comparison, grid, harmonics, kernel, quality, rosters, spatial, tides, trailing, water
from ..sinks import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(name: str) -> Column:
    """Dates and times as text: engines hand them over in different types."""
    return F.col(name).cast("string").alias(name)


def r6(c: Column) -> Column:
    return F.round(c + F.lit(3e-8), 6) + F.lit(0.0)


def r4(c: Column) -> Column:
    return F.round(c + F.lit(3e-6), 4) + F.lit(0.0)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("l_discount").between(0.02, 0.08), F.col("l_extendedprice"))
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), (F.col("l_suppkey") % 80).cast("double").alias("lat"), price.alias("x"))


PX = """with px as (select l_partkey k, cos(radians(cast(l_suppkey % 80 as double))) w, case when l_discount between 0.02 and 0.08 then l_extendedprice end x from lineitem)"""


@query(PX + """, a as (select k, count(*) n, count(x) nv, sum(w * x) / nullif(sum(case when x is not null then w end), 0) m from px group by k)
select p_partkey, coalesce(n, 0) input_pixel_count, coalesce(nv, 0) valid_pixels, round(m + 3e-6, 4) + 0.0 mean_x from part left join a on k = p_partkey""")
def masked_weighted_mean(spark, d):
    support = t(spark, d, "part").select(F.col("p_partkey").alias("cell"))
    out = spatial.aggregate_pixels(pixels(spark, d), support, ["x"])
    return out.select(F.col("cell").alias("p_partkey"), "input_pixel_count", F.col("x_valid_pixels").alias("valid_pixels"), r4(F.col("x")).alias("mean_x"))


@query(PX + """ select k, round(avg(case when x > 0 then ln(x) end) + 3e-8, 6) + 0.0 mean_of_logs, round(ln(avg(case when x > 0 then x end)) + 3e-8, 6) + 0.0 log_of_mean from px group by k""")
def log_and_mean(spark, d):
    x = masks.positive(F.col("x"))
    return pixels(spark, d).groupBy(F.col("cell").alias("k")).agg(r6(F.avg(masks.log_of(F.col("x")))).alias("mean_of_logs"), r6(F.ln(F.avg(x))).alias("log_of_mean"))


@query("""select event_id, case when value between 20 and 80 then value end banded, case when value > 50 then value end above, case when abs(value) < 60 then value end small,
case when user_id % 5 >= 2 and user_id % 5 <= 5 then value end good from events""")
def value_masks(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", masks.physical(v, 20, 80).alias("banded"), F.when(masks.positive(v - 50).isNotNull(), v).alias("above"), masks.magnitude(v, 60).alias("small"),
                                        masks.quality_band(v, F.col("user_id") % 5, 2).alias("good"))


CHILDREN = """with ch as (select n_regionkey r, n_nationkey n, case when s_acctbal > 0 then s_acctbal else 0 end area, case when s_suppkey % 2 = 0 then s_suppkey * cast(1.5 as double) end m, s_suppkey = 7 miss
from supplier join nation on s_nationkey = n_nationkey)"""


def children(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    area = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0)
    return t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n")).select("r", "n", area.alias("area"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") * 1.5).alias("m"), (F.col("s_suppkey") == 7).alias("miss"))


@query(CHILDREN + """ select r, round(sum(a) + 3e-6, 4) + 0.0 area, count(*) nations from (select r, n, sum(area) a from ch group by r, n) group by r""")
def hierarchy_rollup(spark, d):
    key = F.struct("r", "n").alias("key")
    level = spatial.roll_up(children(spark, d).select(key, "area"), "key").select("key.*", "area")
    return spatial.roll_up(level, "r", counted="nations").select("r", r4(F.col("area")).alias("area"), "nations")


@query(CHILDREN + """, g as (select r, sum(area) area, coalesce(sum(case when m is not null then area end), 0) va, sum(m * area) ma, bool_or(miss) miss from ch group by r)
select r, round(area + 3e-6, 4) + 0.0 area, round(va / nullif(area, 0) + 3e-8, 6) + 0.0 frac, miss, round(case when va / nullif(area, 0) >= 0.5 and not miss then ma / nullif(va, 0) end + 3e-8, 6) + 0.0 m from g""")
def gated_rollup(spark, d):
    out = spatial.gated_roll_up(children(spark, d), "r", "m", missing_source=F.col("miss"))
    return out.select("r", r4(F.col("area")).alias("area"), r6(F.col("supported_fraction")).alias("frac"), F.col("missing_source").alias("miss"), r6(F.col("m")).alias("m"))


@query("""with c as (select p_partkey k, (1::bigint << 59) | (8::bigint << 52) | ((p_partkey % 120)::bigint << 45) | ((p_partkey * 7919)::bigint % 16777216 << 21) | 2097151 cell from part)
select k, (cell & ~(15::bigint << 52)) | (6::bigint << 52) | (63::bigint << 21) parent6, (cell & ~(15::bigint << 52)) | (5::bigint << 52) | (511::bigint << 21) parent5 from c""")
def cell_parent_bits(spark, d):
    k = F.col("p_partkey")
    cell = F.lit((1 << 59) | (8 << 52) | 2097151).bitwiseOR(F.shiftleft(k % 120, 45)).bitwiseOR(F.shiftleft(k * 7919 % 16777216, 21))
    return t(spark, d, "part").select(k.alias("k"), cells.parent(cell, 8, 6).alias("parent6"), cells.parent(cell, 8, 5).alias("parent5"))


def _hex_sql(places: str, res: int) -> str:
    """DuckDB: (k, lat, lon) of ``places`` to (k, cell), from the same lattice: nearest face, nearest point, a digit a resolution, the table of cells of resolution 0."""
    centre, north, east, axis = hexagons._frames()
    faces = ", ".join(f"({f}, {', '.join(repr(float(x)) for x in (*centre[f], *north[f], *east[f], axis[f].real, axis[f].imag))})" for f in range(20))
    own = hexagons.solid().table
    base = ", ".join(f"({f}, {a - hexagons.REACH}, {b - hexagons.REACH}, {', '.join(map(str, own[f, a, b]))})" for f, a, b in zip(*np.nonzero(own[..., 0] >= 0), strict=True))
    turns = [hexagons.turned(np.arange(7), r).tolist() for r in range(6)]
    by, steps, last = complex(hexagons.scale(res)), "", "l"
    for k in range(res, 0, -1):
        remainder = f"((a + {hexagons.ROOT[k % 2]} * b) % 7 + 7) % 7 + 1"
        d, da, db = (f"({hexagons._digit_tables()[k % 2][:, c].tolist()})[{remainder}]" for c in range(3))
        up = ("(3 * x - y) // 7 a, (x + 2 * y) // 7 b" if k % 2 else "(2 * x + y) // 7 a, (3 * y - x) // 7 b")
        steps += f"s{k} as (select k, f, list_prepend(d, digits) digits, {up} from (select k, f, digits, {d} d, a - {da} x, b - {db} y from {last})),\n"
        last = f"s{k}"
    return f"""q as (select k, cos(radians(lat)) * cos(radians(lon)) x, cos(radians(lat)) * sin(radians(lon)) y, sin(radians(lat)) z from {places}),
faces(f, cx, cy, cz, nx, ny, nz, ex, ey, ez, ax, ay) as (values {faces}),
near as (select k, first(f order by x * cx + y * cy + z * cz desc) f from q, faces group by k),
flat as (select k, f, (x * nx + y * ny + z * nz) / (x * cx + y * cy + z * cz) n, (x * ex + y * ey + z * ez) / (x * cx + y * cy + z * cz) e, ax, ay from q join near using (k) join faces using (f)),
lat0 as (select k, f, (ax * n + ay * e) / {hexagons.STEP!r} zr, (ay * n - ax * e) / {hexagons.STEP!r} zi from flat),
latr as (select k, f, zr * {by.real!r} - zi * {by.imag!r} zr, zr * {by.imag!r} + zi * {by.real!r} zi from lat0),
cube as (select k, f, zr - zi / {float(hexagons.W.imag)!r} / 2 q, zi / {float(hexagons.W.imag)!r} r from latr),
near3 as (select *, round(q) x, round(r) y, round(-q - r) s, abs(round(q) - q) dx, abs(round(r) - r) dy, abs(round(-q - r) + q + r) ds from cube),
l as (select k, f, []::bigint[] digits, cast(case when dx >= dy and dx >= ds then -s when dy >= ds then -s else x + y end as bigint) a, cast(case when dx >= dy and dx >= ds then y when dy >= ds then -x - s else y end as bigint) b from near3),
{steps}own(f, a, b, base, turns, outwards) as (values {base}),
u as (select k, base, outwards, list_transform(digits, lambda d: ({turns})[turns + 1][d + 1]) digits from {last} join own using (f, a, b)),
v as (select k, base, case when outwards > 0 and list_filter(digits, lambda d: d > 0)[1] = {hexagons.K} then list_transform(digits, lambda d: ({turns})[outwards + 1][d + 1]) else digits end digits from u),
cells as (select k, (1::bigint << 59) | ({res}::bigint << 52) | {(1 << 3 * (15 - res)) - 1} | (base::bigint << 45) | list_sum(list_transform(range(1, {res + 1}), lambda i: digits[i]::bigint << (3 * (15 - i))))::bigint cell from v)"""


_PLACES = "pl as (select o_orderkey k, (o_orderkey * 7919 % 17993)::double / 100 - 89.97 lat, (o_orderkey * 104729 % 35993)::double / 100 - 179.97 lon from orders)"


@query(f"with {_PLACES}, {_hex_sql('pl', 8)} select k, cell, (cell & ~(15::bigint << 52)) | (5::bigint << 52) | (511::bigint << 21) parent5 from cells")
def hex_cells(spark, d):
    k = F.col("o_orderkey")
    cell = cells.hex_cell((k * 7919 % 17993).cast("double") / 100 - 89.97, (k * 104729 % 35993).cast("double") / 100 - 179.97, 8)
    return t(spark, d, "orders").select(k.alias("k"), cell.alias("cell")).withColumn("parent5", cells.parent(F.col("cell"), 8, 5))


@query("""with d as (select user_id u, cast(ts as date) dt, avg(case when value > 20 then value end) x from events group by 1, 2),
sp as (select u, dt from (select distinct u from d) a cross join (select distinct dt from d) b),
j as (select sp.u u, sp.dt dt, datediff('day', date '1970-01-01', sp.dt) n, d.x x from sp left join d on sp.u = d.u and sp.dt = d.dt),
w as (select u, dt, n, avg(x) over w m, count(x) over w k, max(case when x is not null then n end) over w mx, min(case when x is not null then n end) over w mn
from j window w as (partition by u order by n range between 6 preceding and current row))
select u, cast(dt as varchar) dt, round(m + 3e-8, 6) + 0.0 mean7, round(ln(m) + 3e-8, 6) + 0.0 log7, round(case when k >= 2 then m end + 3e-8, 6) + 0.0 mean2p, k valid_days, cast(n - mx as double) newest, cast(n - mn as double) oldest from w""")
def trailing_composite(spark, d):
    daily = t(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("dt")).agg(F.avg(F.when(F.col("value") > 20, F.col("value"))).alias("x"))
    calendar = trailing.spine(daily.select("u").distinct(), daily.select("dt").distinct())
    out = trailing.trailing_composite(daily, calendar, "u", "dt", "x")
    return out.select("u", text("dt"), r6(F.col("trailing_mean")).alias("mean7"), r6(F.col("trailing_log_mean")).alias("log7"), r6(F.col("trailing_2plus_mean")).alias("mean2p"), "valid_days", F.col("newest_age").cast("double").alias("newest"), F.col("oldest_age").cast("double").alias("oldest"))


KERNEL = """with se as (select cast(n_nationkey * 2 as double) pos, case when n_nationkey <> 4 then cast(n_nationkey + 1 as double) end v from nation),
j as (select p_partkey c, abs(p_size - pos) dd, v from part cross join se where abs(p_size - pos) <= 6),
g as (select c, count(*) e, count(v) o, sum(v * exp(-dd / 2)) s, sum(exp(-dd / 2)) tw, min(dd) nearest from j group by c)"""


def seeds_and_distances(spark, d):
    seeds = t(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), (F.col("n_nationkey") * 2).cast("double").alias("pos"), F.when(F.col("n_nationkey") != 4, (F.col("n_nationkey") + 1).cast("double")).alias("value"))
    part = t(spark, d, "part").select(F.col("p_partkey").alias("cell"), "p_size")
    return part, seeds.select("seed", "value"), part.crossJoin(F.broadcast(seeds.select("seed", "pos"))).select("seed", "cell", F.abs(F.col("p_size") - F.col("pos")).alias("distance"))  # 25 seeds


def kernel_query(spark, d, normalize):
    support, values, distances = seeds_and_distances(spark, d)
    out = kernel.influence_on(support, distances, values, 2.0, 3.0, normalize)
    return out.select(F.col("cell").alias("p_partkey"), F.col("expected_sources").alias("expected"), F.col("available_sources").alias("observed"), r6(F.col("value")).alias("val"), F.col("nearest_source").alias("nearest"), r6(F.col("source_completeness")).alias("completeness"))


@query(KERNEL + """ select p_partkey, coalesce(e, 0) expected, coalesce(o, 0) observed, round(case when o = e then s end + 3e-8, 6) + 0.0 val, nearest, round(o / cast(e as double) + 3e-8, 6) + 0.0 completeness from part left join g on c = p_partkey""")
def kernel_sum(spark, d):
    return kernel_query(spark, d, False)


@query(KERNEL + """ select p_partkey, coalesce(e, 0) expected, coalesce(o, 0) observed, round(case when o = e then s / tw end + 3e-8, 6) + 0.0 val, nearest, round(o / cast(e as double) + 3e-8, 6) + 0.0 completeness from part left join g on c = p_partkey""")
def kernel_normalized(spark, d):
    return kernel_query(spark, d, True)


WAYS = """with n as (select s_suppkey k from supplier),
e as (select a.k a, b.k b, cast(1 + a.k % 7 as double) w from n a join n b on b.k = a.k + 1 union all select a.k, b.k, cast(4 + a.k % 5 as double) from n a join n b on b.k = a.k + 10),
e2 as (select a, b, w from e union all select b, a, w from e),
g0 as (select n_nationkey seed, min(s_suppkey) cell, cast(n_nationkey % 3 as double) dd from supplier join nation on n_nationkey = s_nationkey group by n_nationkey),
g as (with recursive r as (select * from g0 union select seed, e2.b, dd + w from r join e2 on r.cell = e2.a where dd + w <= 25) select seed, cell, min(dd) distance from r group by seed, cell)"""


def lattice(spark, d):
    """Suppliers as cells, each beside the next one and the tenth; each nation starts at its first supplier."""
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    ways = s.select(k.alias("source"), F.explode(F.array(F.struct((k + 1).alias("target"), ((1 + k % 7) * 1000.0).alias("distance_m")), F.struct((k + 10).alias("target"), ((4 + k % 5) * 1000.0).alias("distance_m")))).alias("w"))
    edges = water.canonical_edges(ways.select("source", "w.*", F.lit(True).alias("passable")), s.select(k.alias("cell")))
    starts = t(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("seed")).agg(F.min(k).alias("cell"))
    return edges, starts.select("seed", "cell", (F.col("seed") % 3).cast("double").alias("connector_km"))


@query(WAYS + " select * from g")
def water_distance(spark, d):
    """The oracle's recursion keeps each (seed, cell, length) once; lengths are whole numbers up to the cut-off."""
    edges, starts = lattice(spark, d)
    return water.water_distances(edges, starts, cutoff_km=25.0).select("seed", "cell", "distance")


@query(WAYS + """, c as (select n_nationkey * 7 + 1 cell, n_nationkey + 1 target, cast(n_nationkey as double) / 4 km from nation)
select seed, cell, distance from g where cell not in (select cell from c) union all select seed, c.cell, distance + km from g join c on g.cell = c.target""")
def water_connectors(spark, d):
    """One hop from a terminal cell's target overrides the distance over the graph."""
    edges, starts = lattice(spark, d)
    hops = t(spark, d, "nation").selectExpr("n_nationkey * 7 + 1 cell", "n_nationkey + 1 target", "cast(n_nationkey as double) / 4 connector_km")
    return water.water_distances(edges, starts, hops, 25.0).select("seed", "cell", "distance")


@query("""with e as (select least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, l_quantity w, l_returnflag <> 'R' p from lineitem)
select a, b, round(min(w) / 1000 + 3e-8, 6) + 0.0 km from e where p group by a, b""")
def canonical_edges(spark, d):
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").alias("distance_m"), (F.col("l_returnflag") != "R").alias("passable"))
    return water.canonical_edges(e).select("a", "b", r6(F.col("km")).alias("km"))


@query("""with g as (select p_partkey % 50 x, p_partkey // 50 y, cast(p_size as double) u, p_retailprice / 100 v from part),
f as (select x, y, u, (u + lag(u) over (partition by y order by x)) / 2 uc, (v + lag(v) over (partition by x order by y)) / 2 vc from g)
select x, y, round(case when u > 5 then sqrt(uc * uc + vc * vc) end + 3e-8, 6) + 0.0 speed from f""")
def collocation_speed(spark, d):
    g = t(spark, d, "part").selectExpr("p_partkey % 50 x", "p_partkey div 50 y", "cast(p_size as double) u", "p_retailprice / 100 v", "0 t")
    return grid.collocated_speed(g, wet=F.col("u") > 5).select("x", "y", r6(F.col("speed")).alias("speed"))


@query("""with s as (select user_id u, cast(ts as date) dt, event_type, avg(value) v from events group by 1, 2, 3)
select u, cast(dt as varchar) dt, count(v) valid_samples, round(case when count(v) = 5 then avg(v) end + 3e-8, 6) + 0.0 sample_mean, round(case when count(v) = 5 then max(v) end + 3e-8, 6) + 0.0 sample_max from s group by 1, 2""")
def complete_samples(spark, d):
    s = t(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("dt"), "event_type").agg(F.avg("value").alias("v"))
    return grid.complete_samples(s, ["u", "dt"], "v", 5).select("u", text("dt"), "valid_samples", r6(F.col("sample_mean")).alias("sample_mean"), r6(F.col("sample_max")).alias("sample_max"))


@query("""select user_id u, cast(cast(ts as date) as varchar) dt, count(value) sample_count, round(case when count(value) >= 3 then max(value) - min(value) end + 3e-8, 6) + 0.0 value_range from events group by 1, 2""")
def station_range(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("u"), F.to_date("ts").alias("dt"), "value")
    return grid.station_range(e, ["u", "dt"], "value", 3).select("u", text("dt"), "sample_count", r6(F.col("value_range")).alias("value_range"))


@query("""select o_orderkey, round(case when o_totalprice >= 0 then o_totalprice * (case when o_orderstatus = 'O' then cast(0.028316846592 as double) else cast(1 as double) end) end + 3e-6, 4) + 0.0 m3_s from orders""")
def discharge_units(spark, d):
    unit = F.when(F.col("o_orderstatus") == "O", "ft^3/s").otherwise("m3/s")
    value = units.number(F.col("o_totalprice").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", r4(units.discharge_m3_s(value, unit)).alias("m3_s"))


@query("""select n_nationkey, s_suppkey, s_name from nation left join (select * from (select *, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier) where k = 1) on s_nationkey = n_nationkey""")
def roster_left_join(spark, d):
    first = rosters.first_match(t(spark, d, "supplier").withColumn("n_nationkey", F.col("s_nationkey")), ["n_nationkey"], [F.col("s_suppkey")])
    return t(spark, d, "nation").select("n_nationkey").join(first, "n_nationkey", "left").select("n_nationkey", "s_suppkey", "s_name")


@query("""with s as (select cast(ts as date) dt, hour(ts) h, sum(value) v, count(*) c from events where event_type = 'click' group by 1, 2)
select cast(dt as varchar) dt, cast(h as int) "hour", round(v + 3e-6, 4) + 0.0 "value" from (select distinct dt from s) cross join (select unnest(generate_series(0, 23)) h) left join s using (dt, h)""")
def hourly_reindex(spark, d):
    s = t(spark, d, "events").where("event_type = 'click'").groupBy(F.to_date("ts").alias("dt"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("value"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return comparison.on_spine(hours, s, ["dt"]).select(text("dt"), "hour", r4(F.col("value")).alias("value"))


@query("""select o_orderkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)""")
def support_semi(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left_semi").select("o_orderkey")


@query("""select cast(cast(x as date) as varchar) dt from (select unnest(generate_series(date '1995-01-01', date '1996-12-31', interval 1 day)) x) where cast(x as date) not in (select cast(o_orderdate as date) from orders where o_orderstatus = 'F')""")
def missing_partitions(spark, d):
    have = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.to_date("o_orderdate").alias("dt"))
    return quality.missing(trailing.date_spine(spark, "1995-01-01", "1996-12-31", "dt"), have, ["dt"]).select(text("dt"))


TRIANGLES = """with tri as (select n_nationkey tri, cast(n_nationkey * 2 as double) x0, cast(0 as double) y0, cast(n_nationkey * 2 + 3 as double) x1, cast(n_nationkey as double) y1, cast(n_nationkey * 2 as double) x2, cast(n_nationkey + 4 as double) y2 from nation),
pt as (select p_partkey point, cast(p_size as double) px, p_retailprice / 60 py from part),
d as (select *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) det from tri),
w as (select point, tri, ((px - x0) * (y2 - y0) - (py - y0) * (x2 - x0)) / det w1, ((py - y0) * (x1 - x0) - (px - x0) * (y1 - y0)) / det w2 from pt, d),
hit as (select *, 1 - w1 - w2 w0 from w where w1 >= -1e-12 and w2 >= -1e-12 and 1 - w1 - w2 >= -1e-12)"""


def mesh(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey")
    nodes = n.select((k * 3).alias("node"), (k * 2.0).alias("lon"), F.lit(0.0).alias("lat")).unionByName(n.select((k * 3 + 1).alias("node"), (k * 2.0 + 3).alias("lon"), k.cast("double").alias("lat"))).unionByName(n.select((k * 3 + 2).alias("node"), (k * 2.0).alias("lon"), (k + 4.0).alias("lat")))
    elements = n.select(k.alias("tri"), *((k * 3 + j).alias(f"n{j}") for j in range(3)))
    points = t(spark, d, "part").select(F.col("p_partkey").alias("point"), F.col("p_size").cast("double").alias("lon"), (F.col("p_retailprice") / 60).alias("lat"))
    return points, nodes, elements


@query(TRIANGLES + """ select point, tri, round(w0 + 3e-8, 6) + 0.0 w0, round(w1 + 3e-8, 6) + 0.0 w1, round(w2 + 3e-8, 6) + 0.0 w2 from hit""")
def triangle_join(spark, d):
    points, nodes, elements = mesh(spark, d)
    out = harmonics.points_in_triangles(points, harmonics.corners(elements, nodes))
    return out.select("point", "tri", *(r6(F.col(f"w{k}")).alias(f"w{k}") for k in range(3)))


@query(TRIANGLES + """, v as (select point, tri, w0 * cos(tri * 3) + w1 * cos(tri * 3 + 1) + w2 * cos(tri * 3 + 2) re, w0 * sin(tri * 3) + w1 * sin(tri * 3 + 1) + w2 * sin(tri * 3 + 2) im from hit),
f as (select *, first_value(re) over o r0, first_value(im) over o i0 from v window o as (partition by point order by tri)),
g as (select point, min(tri) tri, max(sqrt((re - r0) * (re - r0) + (im - i0) * (im - i0))) off, min_by(re, tri) re, min_by(im, tri) im from f group by point)
select p_partkey point, cast(case when off > 1e-6 then -2 else coalesce(tri, -1) end as int) triangle, round(case when off <= 1e-6 then re end + 3e-8, 6) + 0.0 re, round(case when off <= 1e-6 then im end + 3e-8, 6) + 0.0 im from part left join g on point = p_partkey""")
def harmonic_interpolation(spark, d):
    points, nodes, elements = mesh(spark, d)
    h = nodes.select("node", F.lit("M2").alias("constituent"), F.cos(F.col("node").cast("double")).alias("re"), F.sin(F.col("node").cast("double")).alias("im"))
    out = harmonics.interpolate(points, nodes, elements, h)
    return out.select("point", F.col("triangle").cast("int").alias("triangle"), r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


@query("""with s as (select n_nationkey seed, cast(n_nationkey * 137 % 2000 as double) x, cast(n_nationkey * 71 % 1000 as double) y from nation), p as (select p_partkey cell, p_retailprice * 20 % 2000 px, cast(p_size * 20 as double) py from part),
k as (select seed, cell, sqrt((x - px) * (x - px) + (y - py) * (y - py)) / 1000 snap from s, p where abs(x - px) <= 500 and abs(y - py) <= 500)
select seed, cell, cast(c as int) choice, round(snap + 3e-8, 6) + 0.0 snap_km from (select *, row_number() over (partition by seed order by round(snap, 9), cell) c from k where snap <= 0.5) where c <= 3""")
def knn_seeds(spark, d):
    seeds = t(spark, d, "nation").selectExpr("n_nationkey seed", "cast(n_nationkey * 137 % 2000 as double) x", "cast(n_nationkey * 71 % 1000 as double) y")
    nodes = t(spark, d, "part").selectExpr("p_partkey cell", "p_retailprice * 20 % 2000 x", "cast(p_size * 20 as double) y")
    out = water.nearest_nodes(seeds, nodes, 3, 0.5)
    return out.select("seed", "cell", "choice", r6(F.col("snap_km")).alias("snap_km"))


@query("""with c as (select s_suppkey, case when s_acctbal > 0 then s_acctbal else 0 end area, case when s_suppkey % 2 = 0 then 1 end a, case when s_suppkey % 3 = 0 then 1 end b from supplier)
select 'a' metric, count(a) valid_cells, count(*) total_cells, round(sum(case when a is not null then area end) / sum(area) + 3e-8, 6) + 0.0 frac from c
union all select 'b', count(b), count(*), round(sum(case when b is not null then area end) / sum(area) + 3e-8, 6) + 0.0 from c""")
def coverage(spark, d):
    c = t(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).otherwise(0.0).alias("area"), F.when(F.col("s_suppkey") % 2 == 0, 1.0).alias("a"), F.when(F.col("s_suppkey") % 3 == 0, 1.0).alias("b"))
    return spatial.coverage(c, ["a", "b"]).select("metric", "valid_cells", "total_cells", r6(F.col("valid_area_fraction")).alias("frac"))


@query("""with a as (select user_id u, cast(ts as date) d, avg(case when event_type = 'click' then value end) o, avg(case when event_type = 'view' then value end) p from events group by 1, 2)
select cast(d as varchar) d, count(*) n, round(avg(o) + 3e-8, 6) + 0.0 mo, round(avg(p) + 3e-8, 6) + 0.0 mp, round(avg(abs(o - p)) + 3e-8, 6) + 0.0 mae, round(sqrt(var_pop(o - p)) + 3e-8, 6) + 0.0 rmse,
round(covar_pop(o, p) / nullif(stddev_pop(o) * stddev_pop(p), 0) + 3e-8, 6) + 0.0 corr, round((max(p) - min(p)) - (max(o) - min(o)) + 3e-8, 6) + 0.0 range_error from a where o is not null and p is not null group by d""")
def overlap_compare(spark, d):
    pick = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    a = t(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("d")).agg(pick("click").alias("o"), pick("view").alias("p"))
    out = comparison.agreement(a, ["d"], "o", "p")
    return out.select(text("d"), "n", r6(F.col("mean_observed")).alias("mo"), r6(F.col("mean_predicted")).alias("mp"), r6(F.col("mae")).alias("mae"), r6(F.col("demeaned_rmse")).alias("rmse"), r6(F.col("correlation")).alias("corr"), r6(F.col("range_error")).alias("range_error"))


@query("""with c as (select user_id % 10 k, value area, event_type = 'click' o, event_type in ('click', 'view') and user_id % 3 = 0 b from events)
select k, round(sum(case when o then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 original, round(sum(case when b then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 broader, round(sum(case when o or b then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 either from c group by k""")
def complementary_fractions(spark, d):
    c = t(spark, d, "events").select((F.col("user_id") % 10).alias("k"), F.col("value").alias("area"), "event_type", "user_id")
    out = comparison.complementary(c, F.col("event_type") == "click", F.col("event_type").isin("click", "view") & (F.col("user_id") % 3 == 0), keys=("k",))
    return out.select("k", *(r6(F.col(f"{x}_fraction")).alias(x) for x in ("original", "broader", "either")))


@query("""select cast(cast(o_orderdate as date) as varchar) dt, case when bool_or(o_orderpriority = '1-URGENT' and o_orderkey % 50 = 0) then 'unavailable' when sum(case when o_orderstatus = 'P' then 1 else 0 end) > 0 then 'partial' else 'available' end status from orders group by 1""")
def status_rollup(spark, d):
    o = t(spark, d, "orders").select(F.to_date("o_orderdate").alias("dt"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 50 == 0)).alias("failed"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("errors"))
    return quality.status(o, ["dt"]).select(text("dt"), "status")


@query("""select user_id, cast(date_trunc('hour', ts) as varchar) "hour", count(*) n from events group by 1, 2 having count(*) > 1""")
def dup_keys(spark, d):
    return quality.duplicates(t(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour")), ["user_id", "hour"]).select("user_id", text("hour"), "n")


@query("""select event_id, cast(props ->> '$.k' as bigint) k from events""")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("""select 'customer' kind, c_custkey id, c_name "name", c_mktsegment segment from customer union all select 'supplier', s_suppkey, s_name, null from supplier""")
def bounded_union(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return rosters.bag_union([c, s], "kind", ["customer", "supplier"]).select("kind", "id", "name", "segment")


@query("""select c_custkey, sha256(c_name) digest from customer""")
def checksum(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))


@query("""select s_suppkey, round(((s_acctbal % 360) + 360) % 360 + 3e-6, 4) + 0.0 lon360, round((((s_acctbal + 180) % 360) + 360) % 360 - 180 + 3e-6, 4) + 0.0 lon180 from supplier""")
def longitudes(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", r4(masks.longitude_360(F.col("s_acctbal"))).alias("lon360"), r4(masks.longitude_180(F.col("s_acctbal"))).alias("lon180"))


@query("""select c.c_custkey, n.n_name is not null in_support, coalesce(n.n_name, 'none') n_name from customer c left join (select * from nation where n_regionkey < 2) n on c_nationkey = n_nationkey""")
def point_probes(spark, d):
    nation = t(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("cell"), "n_name")
    return rosters.probes(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cell")), nation).select("c_custkey", "in_support", F.coalesce("n_name", F.lit("none")).alias("n_name"))


@query("""with h as (select p_partkey point, cos(p_size) re, sin(p_size) im from part), t as (select unnest(generate_series(0, 23)) h)
select point, round(max(v) - min(v) + 3e-8, 6) + 0.0 hourly_range from (select point, re * cos(radians(cast(28.9841042 as double) * h)) - im * sin(radians(cast(28.9841042 as double) * h)) v from h, t) group by point""")
def tide_range(spark, d):
    c = t(spark, d, "part").select(F.col("p_partkey").alias("point"), F.lit("M2").alias("constituent"), F.cos(F.col("p_size").cast("double")).alias("re"), F.sin(F.col("p_size").cast("double")).alias("im"))
    hours = spark.range(24).select(F.col("id").cast("double").alias("hours"))
    speeds = spark.range(1).select(F.lit("M2").alias("constituent"), F.lit(harmonics.SPEEDS["M2"]).alias("speed"), F.lit(1.0).alias("f"), F.lit(0.0).alias("v"))
    return harmonics.daily_range(harmonics.predict(c, hours, speeds)).select("point", r6(F.col("hourly_range")).alias("hourly_range"))


def _tides_sql() -> str:
    angle = lambda c: f"({c[0]} + {c[1]} * d + {c[2]} * pow(d / 10000, 2) + {c[3]} * pow(d / 10000, 3)) / 360"
    lines = [f"('{name}', {', '.join(map(str, (*own, phase)))})" for name, (own, phase, _) in tides.CONSTITUENTS.items()]
    beside = [f"('{name}', {', '.join(map(str, s))})" for name, (_, _, more) in tides.CONSTITUENTS.items() for s in more]
    return f"""with lines(c, m0, m1, m2, m3, m4, m5, ph) as (values {", ".join(lines)}), beside(c, p, n, q, ph, ratio, kind) as (values {", ".join(beside)}),
h as (select unnest(range(24)) h), e as (select h, (epoch(timestamp '2024-07-01') + 3600 * h) / 86400.0 + {tides.EPOCH} d, h / 24.0 f from h),
a as (select h, f + {angle(tides.SUN)} - {angle(tides.MOON)} a0, {angle(tides.MOON)} a1, {angle(tides.SUN)} a2, {angle(tides.PERIGEE)} a3, {angle(tides.NODE)} a4, {angle(tides.SUN_PERIGEE)} a5 from e),
v as (select h, c, 2 * pi() * (m0 * a0 + m1 * a1 + m2 * a2 + m3 * a3 + m4 * a4 + m5 * a5 + ph) v from a, lines),
p as (select p_partkey k, cast(p_partkey % 170 - 85 as double) lat, cast(p_size as double) / 25 amp from part),
s as (select k, sin(radians(case when abs(lat) < 5 then case when lat < 0 then -5 else 5 end else lat end)) s from p),
g as (select k, h, c, 1 + sum(r * cos(w)) gr, sum(r * sin(w)) gi from (select k, h, c, ratio * case kind when 1 then {tides.DIURNAL} * (1 - 5 * s * s) / s when 2 then {tides.SEMIDIURNAL} * s else 1 end r, 2 * pi() * (p * a3 + n * a4 + q * a5 + ph) w from s, a, beside) group by all),
t as (select k, h, sum(sqrt(gr * gr + gi * gi) * amp / (1 + length(c) + ascii(c)) * cos(v + atan2(gi, gr) - radians(cast(k * 37 % 360 + ascii(c) as double)))) y from g join v using (h, c) join p using (k) group by k, h)"""


@query(_tides_sql() + " select k, round(max(y) - min(y) + 3e-6, 4) + 0.0 tide_range, round(avg(y) + 3e-6, 4) + 0.0 mean_height from t group by k")
def nodal_tides(spark, d):
    """Eight constituents at each part's latitude on one day."""
    names = F.explode(F.array(*(F.lit(n) for n in tides.CONSTITUENTS))).alias("constituent")
    each = t(spark, d, "part").select(F.col("p_partkey").alias("point"), (F.col("p_partkey") % 170 - 85).cast("double").alias("lat"), "p_size", names)
    amplitude = F.col("p_size").cast("double") / 25 / (1 + F.length("constituent") + F.ascii("constituent"))
    re, im = harmonics.from_polar(amplitude, (F.col("point") * 37 % 360 + F.ascii("constituent")).cast("double"))
    made = tides.heights(each.select("point", "lat", "constituent", re.alias("re"), im.alias("im")), tides.hours_of(spark, "2024-07-01"))
    return made.groupBy(F.col("point").alias("k")).agg(r4(F.max("height") - F.min("height")).alias("tide_range"), r4(F.avg("height")).alias("mean_height"))


@query(CHILDREN + """ select r, round(sum(case when area > 0 then area * n end) / sum(case when area > 0 then area end) + 3e-8, 6) + 0.0 mean_n, round(sum(case when area > 0 then m * area end) / nullif(sum(case when area > 0 and m is not null then area end), 0) + 3e-8, 6) + 0.0 mean_m from ch group by r""")
def rollup_diagnostics(spark, d):
    """Means of diagnostics over children that have one and an area."""
    out = spatial.gated_roll_up(children(spark, d).withColumn("d", F.col("m")), "r", "m", diagnostics=("n", "d"))
    return out.select("r", r6(F.col("mean_n")).alias("mean_n"), r6(F.col("mean_d")).alias("mean_m"))


UPSCALED = """with f as (select o_custkey % 40 k, cast(o_orderdate as date) dt, o_totalprice area, case when o_orderkey % 3 > 0 then cast(o_orderkey % 10 as double) end v from orders),
u as (select k, dt, sum(case when v is not null then area else 0 end) / sum(area) frac, sum(v * area) / nullif(sum(case when v is not null then area end), 0) m from f group by k, dt)"""


@query(UPSCALED + """ select k, round(case when frac >= 0.5 then m end + 3e-8, 6) + 0.0 regional, cast(dt as varchar) dt from u""")
def gated_upscale(spark, d):
    """Regional cells at the broader resolution, day by day, without a source gate."""
    o = t(spark, d, "orders").select(F.struct((F.col("o_custkey") % 40).alias("k"), F.to_date("o_orderdate").alias("dt")).alias("key"), F.col("o_totalprice").alias("area"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 10).cast("double")).alias("v"))
    return spatial.gated_roll_up(o, "key", "v").select("key.*", "v").select("k", text("dt"), r6(F.col("v")).alias("regional"))


@query("""with c as (select p_partkey k, (1::bigint << 59) | (6::bigint << 52) | ((p_partkey % 20)::bigint << 30) | ((p_partkey % 7)::bigint << 27) | 134217727 cell from part),
v as (select (1::bigint << 59) | (5::bigint << 52) | (n_nationkey::bigint << 30) | 1073741823 cell, n_name from nation where n_regionkey <> 2)
select k, n_name from c left join v on v.cell = (c.cell & ~(15::bigint << 52)) | (5::bigint << 52) | (511::bigint << 21)""")
def parent_values(spark, d):
    """Cells with their parent's value. Digits of resolution 6 sit at bit 27."""
    k = F.col("p_partkey")
    cell = F.lit((1 << 59) | (6 << 52) | 134217727).bitwiseOR(F.shiftleft((k % 20).cast("long"), 30)).bitwiseOR(F.shiftleft((k % 7).cast("long"), 27))
    coarse = t(spark, d, "nation").where("n_regionkey <> 2").select(F.lit((1 << 59) | (5 << 52) | 1073741823).bitwiseOR(F.shiftleft(F.col("n_nationkey").cast("long"), 30)).alias("cell"), "n_name")
    return comparison.with_parent_value(t(spark, d, "part").select(k.alias("k"), cell.alias("cell")), coarse, "n_name", 6, 5).select("k", "n_name")


@query("""select p_partkey % 50 x, p_partkey // 50 y, p_size u, p_size * 2 + p_partkey % 50 v from part""")
def aligned_rasters(spark, d):
    """Two rasters whose coordinates are the same."""
    g = t(spark, d, "part").selectExpr("p_partkey % 50 x", "p_partkey div 50 y", "p_size u")
    return grid.aligned(g, g.selectExpr("x", "y", "u * 2 + x v"), ["x", "y"]).select("x", "y", "u", "v")


@query("""with c as (select s_suppkey k from supplier where s_acctbal > 0) select least(l_partkey, l_suppkey) a, greatest(l_partkey, l_suppkey) b, round(min(l_quantity) / 1000 + 3e-8, 6) + 0.0 km from lineitem
where l_returnflag <> 'R' and l_partkey in (select k from c) and l_suppkey in (select k from c) group by 1, 2""")
def supported_edges(spark, d):
    """Only edges with both ends in the support."""
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_quantity").alias("distance_m"), (F.col("l_returnflag") != "R").alias("passable"))
    return water.canonical_edges(e, t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cell"))).select("a", "b", r6(F.col("km")).alias("km"))


@query("""select s_suppkey from supplier where case when s_suppkey % 4 = 0 then null else s_acctbal > 0 end and s_suppkey % 3 > 0""")
def eligible_nodes(spark, d):
    """P10: a missing eligibility is no."""
    n = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal") > 0).alias("eligible"), (F.col("s_suppkey") % 3).alias("degree"))
    return water.graph_nodes(n).select("s_suppkey")


@query("""select p_partkey from part where coalesce(p_size % 2 = 0, false)""")
def wet_cells(spark, d):
    """P8."""
    return spatial.wet(t(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("overlap")), "overlap").select("p_partkey")


@query("""select event_id, strftime(ts, '%Y%m%d') compact from events where cast(ts as date) = date '2024-01-03'""")
def same_day(spark, d):
    """Samples of one day, with its date in the providers' compact form."""
    return grid.on_day(t(spark, d, "events"), "2024-01-03").select("event_id", trailing.compact_day(F.col("ts")).alias("compact"))


@query("""select o_custkey, o_orderkey from (select o_custkey, o_orderkey, o_totalprice v, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) b from orders) where v >= b""")
def rising_axis(spark, d):
    """V4: places where an axis that should fall does not."""
    return quality.falling(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("""with p as (select p_partkey k, radians(46 + cast(p_size as double) / 10) phi, radians(-126 + cast(p_partkey % 60 as double) / 10 + 123) lam, 1 / cast(298.257223563 as double) f from part),
c as (select *, f / (2 - f) n from p), e as (select *, 2 * sqrt(n) / (1 + n) ec, 6378137.0 / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) a, n / 2 - 2 * n * n / 3 + 5 * n ** 3 / 16 a1, 13 * n * n / 48 - 3 * n ** 3 / 5 a2, 61 * n ** 3 / 240 a3 from c),
t as (select *, sinh(atanh(sin(phi)) - ec * atanh(ec * sin(phi))) tt from e), x as (select *, atan2(tt, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + tt * tt)) eta from t)
select k, round(500000 + 0.9996 * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) + 3e-3, 2) + 0.0 east,
round(0.9996 * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + 3e-3, 2) + 0.0 north from x""")
def utm_coordinates(spark, d):
    """F28."""
    p = t(spark, d, "part").select("p_partkey", (46 + F.col("p_size").cast("double") / 10).alias("lat"), (-126 + (F.col("p_partkey") % 60).cast("double") / 10).alias("lon"))
    east, north = water.utm10(F.col("lon"), F.col("lat"))
    r2 = lambda c: F.round(c + F.lit(3e-3), 2) + F.lit(0.0)
    return p.select(F.col("p_partkey").alias("k"), r2(east).alias("east"), r2(north).alias("north"))


@query("""select p_partkey k, round(p_size * cos(radians(cast(p_partkey % 360 as double))) + 3e-8, 6) + 0.0 re, round(-p_size * sin(radians(cast(p_partkey % 360 as double))) + 3e-8, 6) + 0.0 im from part""")
def polar_form(spark, d):
    """F10."""
    re, im = harmonics.from_polar(F.col("p_size").cast("double"), (F.col("p_partkey") % 360).cast("double"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("k"), r6(re).alias("re"), r6(im).alias("im"))


@query("""select p_partkey, metric, v from (select p_partkey, cast(p_size as double) size, p_retailprice price from part) unpivot (v for metric in (size, price))""")
def long_metrics(spark, d):
    """P25."""
    return grid.wide_to_long(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["p_partkey"], ["size", "price"], "metric", "v")


@query("""select l_orderkey, l_quantity from lineitem where l_linenumber = 1""")
def surface_level(spark, d):
    """The level with index 0."""
    return grid.surface(t(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_linenumber") - 1).alias("depth_index"))).select("l_orderkey", "l_quantity")


@query("""select n_nationkey lat, r_regionkey lon from nation, region""")
def flat_axes(spark, d):
    """P24, J18."""
    return grid.flatten(t(spark, d, "nation").select(F.col("n_nationkey").alias("lat")), t(spark, d, "region").select(F.col("r_regionkey").alias("lon")))


@query("""select c_custkey, coalesce(n_name, 'open sea') n_name from customer left join (select * from nation where n_regionkey > 1) on n_nationkey = c_nationkey""")
def default_lookup(spark, d):
    """J20."""
    names = t(spark, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return rosters.lookup(t(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", "open sea").select("c_custkey", "n_name")


@query("""select n_nationkey, round(v + 3e-6, 4) + 0.0 v from nation left join (select s_nationkey, sum(s_acctbal) v from supplier where s_nationkey % 3 > 0 group by 1) on s_nationkey = n_nationkey""")
def roster_features(spark, d):
    """One feature a roster row at most."""
    f = t(spark, d, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("s_acctbal").alias("v"))
    return rosters.roster_values(t(spark, d, "nation").select("n_nationkey"), f, ["n_nationkey"]).select("n_nationkey", r4(F.col("v")).alias("v"))


@query("""select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey""")
def inventory_join(spark, d):
    """Every supplier's nation is in the inventory."""
    return rosters.require_inventory(t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), t(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("s_suppkey", "n_name")


@query("""select s_suppkey, case when s_suppkey % 2 = 0 or s_acctbal > 0 then 'available' else 'unavailable' end "FEATURE_STATUS", '2024-07-01' "DATE", cast(6 as int) "CELL_RESOLUTION" from supplier""")
def feature_status(spark, d):
    """P21-P23, A.13: what all feature tables share; counts of pixels are no metrics."""
    s = t(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, 1.0).alias("SST_MEAN_C"), F.when(F.col("s_acctbal") > 0, 2.0).alias("SST_MAX_C"), F.lit(1).alias("SST_MEAN_C_VALID_PIXELS"))
    return tables.decorate(s, "ocean_temperature", "2024-07-01", 6, tables.metric_columns(s, ("SST_",)), "CELL_RESOLUTION").select("s_suppkey", "FEATURE_STATUS", "DATE", "CELL_RESOLUTION")


@query("""with c as (select p_partkey // 20 g, p_partkey % 5 x, p_partkey // 5 % 4 y from part), s as (select distinct * from c),
e as (select g, unnest([x || ' ' || y || ' ' || (x + 1) || ' ' || y, x || ' ' || (y + 1) || ' ' || (x + 1) || ' ' || (y + 1), x || ' ' || y || ' ' || x || ' ' || (y + 1), (x + 1) || ' ' || y || ' ' || (x + 1) || ' ' || (y + 1)]) seg from s)
select g, seg from e group by g, seg having count(*) = 1""")
def dissolved_outline(spark, d):
    """Outlines of groups of unit squares."""
    p = t(spark, d, "part").selectExpr("p_partkey div 20 g", "p_partkey % 5 x", "p_partkey div 5 % 4 y").distinct()
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    out = water.dissolve(p.select("g", F.array(*(corner(*c) for c in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("ring")), "g")
    return out.select("g", F.concat_ws(" ", "a.x", "a.y", "b.x", "b.y").alias("seg"))



@query("""with recursive c as (select distinct p_partkey // 60 g, p_partkey % 9 x, p_partkey // 9 % 9 y from part where p_size % 3 > 0),
d as (select g, unnest([[x, y, x + 1, y], [x + 1, y, x + 1, y + 1], [x + 1, y + 1, x, y + 1], [x, y + 1, x, y]]) s from c),
e as (select g, s, row_number() over (order by g, s) id from d a where not exists (select 1 from d b where b.g = a.g and b.s = [a.s[3], a.s[4], a.s[1], a.s[2]])),
n as (select a.id, arg_max(b.id, ((b.s[3] - b.s[1]) * (a.s[4] - a.s[2]) - (b.s[4] - b.s[2]) * (a.s[3] - a.s[1])) * -1) nx from e a join e b on a.g = b.g and b.s[1] = a.s[3] and b.s[2] = a.s[4] group by a.id),
w as (select id, nx h from n union select w.id, n.nx from w join n on n.id = w.h),
r as (select e.g, e.s, e.id, least(e.id, min(w.h)) ring from e join w on w.id = e.id group by e.g, e.s, e.id)
select g, count(*) sides, sum(s[1] * s[4] - s[3] * s[2]) / 2.0 area from r group by g, ring""")
def outline_rings(spark, d):
    """Rings of groups of unit squares with gaps: parts, holes and corners that touch."""
    p = t(spark, d, "part").where("p_size % 3 > 0").selectExpr("p_partkey div 60 g", "p_partkey % 9 x", "p_partkey div 9 % 9 y").distinct()
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    out = water.outlines(p.select("g", F.array(*(corner(*c) for c in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))).alias("ring")), "g")
    return out.select("g", (F.size("points") - 1).cast("long").alias("sides"), F.col("area").cast("double").alias("area"))


@query("""with s as (select user_id u, count(distinct event_type) k, count(*) n from events group by 1) select u, n, case when u % 7 = 0 then 'outside_or_ambiguous_native_mesh' when k < 5 then 'reference_incomplete' else 'compared' end status from s""")
def station_states(spark, d):
    """A.12."""
    s = t(spark, d, "events").groupBy(F.col("user_id").alias("u")).agg(F.count_distinct("event_type").alias("k"), F.count(F.lit(1)).alias("n"))
    return s.select("u", "n", comparison.station_status(F.when(F.col("u") % 7 == 0, harmonics.OUTSIDE).otherwise(1), F.col("k") >= 5).alias("status"))


@query("""with c as (select distinct o_custkey % 60 k, o_orderdate dt, (1::bigint << 59) | (6::bigint << 52) | ((o_custkey % 60 % 7)::bigint << 45) | ((o_custkey % 60)::bigint << 27) | 134217727 cell from orders where o_orderkey % 2 = 0),
f as (select cell, c.dt, k, cast(1 + k % 5 as double) area, max(case when o_orderkey % 3 > 0 then o_totalprice end) v from c join orders on o_custkey % 60 = k and o_orderdate = c.dt and o_orderkey % 2 = 0 group by all),
b as (select distinct (1::bigint << 59) | (5::bigint << 52) | ((o_custkey % 60 % 7)::bigint << 45) | (((o_custkey % 60)::bigint << 27) & ~((1::bigint << 30) - 1)) | 1073741823 cell, o_orderdate dt from orders where o_orderkey % 5 = 0),
j as (select f.dt, area, v is not null o, b.cell is not null w from f left join b on b.dt = f.dt and b.cell = (f.cell & ~(15::bigint << 52)) | (5::bigint << 52) | (7::bigint << 27))
select cast(dt as varchar) "DATE", round(sum(case when o then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 original_fraction, round(sum(case when w then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 broader_fraction,
       round(sum(case when o or w then area else 0 end) / sum(area) + 3e-8, 6) + 0.0 either_fraction from j group by dt""")
def daily_coverage(spark, d):
    """A23 by day: fine cells with a value, broader cells with one on the same day, and either."""
    from . import runner

    orders = t(spark, d, "orders").select(F.col("o_custkey") % 60, "o_orderdate", "o_orderkey", "o_totalprice").toDF("k", "DATE", "key", "price")
    base = lambda res: F.lit((1 << 59) | (res << 52)).bitwiseOR(F.shiftleft((F.col("k") % 7).cast("long"), 45)).bitwiseOR(F.shiftleft(F.col("k").cast("long"), 27))
    own = orders.where("key % 2 = 0").groupBy("k", "DATE").agg(F.max(F.when(F.col("key") % 3 > 0, F.col("price"))).alias("fine"))
    own = own.select(base(6).bitwiseOR(F.lit(134217727)).alias("cell"), "DATE", (1 + F.col("k") % 5).cast("double").alias("area"), "fine")
    broader = orders.where("key % 5 = 0").select(cells.parent(base(6).bitwiseOR(F.lit(134217727)), 6, 5).alias("cell"), "DATE").distinct().withColumn("broader", F.lit(1.0))
    got = runner.source_coverage(own, broader, "fine", "broader", 6, 5)
    return got.select(text("DATE"), *(r6(F.col(c)).alias(c) for c in ("original_fraction", "broader_fraction", "either_fraction")))
