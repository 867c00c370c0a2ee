"""Queries over rasters, projections and areas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.functions import geo
from ridgeloom.operators import areas, raster, routes
from ridgeloom.plans.catalog import NODES, WITH, edges, nodes, points, read
from ridgeloom.plans.registry import query

_ND = f"with lat_nodes as ({NODES}) "


def _krueger(zone: int) -> str:
    f = 1 / 298.257222101
    n = f / (2 - f)
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * math.sqrt(n) / (1 + n)
    w = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    sinh, cosh, atanh = (lambda v: f"((exp({v}) - exp(-({v}))) / 2)"), (lambda v: f"((exp({v}) + exp(-({v}))) / 2)"), (lambda v: f"(ln((1 + {v}) / (1 - {v})) / 2)")
    x = "eta" + "".join(f" + {c!r} * cos({2 * k} * xi) * {sinh(f'{2 * k} * eta')}" for k, c in enumerate(w, 1))
    y = "xi" + "".join(f" + {c!r} * sin({2 * k} * xi) * {cosh(f'{2 * k} * eta')}" for k, c in enumerate(w, 1))
    return f"""a as (select id, sin(radians(lat_e7 / 1e7)) as s, radians(lon_e7 / 1e7 - {6 * zone - 183}) as d from lat_nodes),
b as (select id, d, {sinh(f"{atanh('s')} - {e!r} * {atanh(f'({e!r} * s)')}")} as t from a), c as (select id, atan2(t, cos(d)) as xi, {atanh('(sin(d) / sqrt(1 + t * t))')} as eta from b)
select id, round(500000 + {scale!r} * ({x}), 2) as easting, round({scale!r} * ({y}), 2) as northing from c"""


@query("node_utm", _ND + ", " + _krueger(32))
def node_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.utm(F.col("lat"), F.col("lon"), 32)
    return nodes(spark, sf_dir).select("id", F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"))


@query("node_planar", _ND + """select a.id, round(sqrt(pow((b.lon_e7 - a.lon_e7) / 1e7 * cos(radians((a.lat_e7 / 1e7 + b.lat_e7 / 1e7) / 2)), 2) + pow((b.lat_e7 - a.lat_e7) / 1e7, 2)) * 111195, 3) as metres,
round(radians((b.lon_e7 - a.lon_e7) / 1e7) * 6371000 * cos(radians(a.lat_e7 / 1e7)), 3) as east, round(radians((b.lat_e7 - a.lat_e7) / 1e7) * 6371000, 3) as north from lat_nodes a join lat_nodes b on b.id = a.id + 41""")
def node_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance in the plane, and metres east and north, from each node to the one across its lattice cell."""
    a = nodes(spark, sf_dir).select("id", "lat", "lon")
    both = a.join(a.selectExpr("id - 41 as id", "lat as lat2", "lon as lon2"), "id")
    lat, lon, lat2, lon2 = (F.col(c) for c in ("lat", "lon", "lat2", "lon2"))
    east, north = geo.metres_from(lat, lon, lat2, lon2)
    return both.select("id", F.round(geo.planar(lat, lon, lat2, lon2), 3).alias("metres"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("slope_weights", _ND + "select id, round(exp(3.5 * (abs(greatest(-0.4, least(0.4, (elev_dm - 1250) / 1000.0)) + 0.05) - 0.05)), 6) as weight from lat_nodes")
def slope_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", F.round(geo.slope_weight(((F.col("elev_dm") - 1250) / 1000)), 6).alias("weight"))


_DEM = f"{_ND}, dem as (select cast(x as bigint) as gi, cast(y as bigint) as gj, case when id % 97 <> 5 then elev_dm / 10.0 end as z from lat_nodes), "
_ASKED = "select s_suppkey as id, cast((s_suppkey * 37) % 1031 as double) as x, cast((s_suppkey * 101) % 1297 as double) as y from supplier"


@query("dem_samples", _DEM + f"""p as (select id, (x / 25.0) - 0.5 as fx, (y / 25.0) - 0.5 as fy from ({_ASKED})),
q as (select id, cast(floor(fx) as bigint) as i, cast(floor(fy) as bigint) as j, cast(fx - floor(fx) as float) as tx, cast(fy - floor(fy) as float) as ty from p),
f as (select q.*, cast(a.z as float) as a, cast(b.z as float) as b, cast(c.z as float) as c, cast(e.z as float) as e from q left join dem a on a.gi = i and a.gj = j left join dem b on b.gi = i + 1 and b.gj = j
left join dem c on c.gi = i and c.gj = j + 1 left join dem e on e.gi = i + 1 and e.gj = j + 1)
select id, cast(round((a + (b - a) * tx + ((c + (e - c) * tx) - (a + (b - a) * tx)) * ty)::double * 10) as int) as elev_dm from f""")
def dem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = nodes(spark, sf_dir).selectExpr("bigint(x) as gi", "bigint(y) as gj", "case when id % 97 <> 5 then elev_dm / 10D end as z")
    asked = spark.sql(_ASKED.replace("from supplier", "from {s}"), s=read(spark, sf_dir, "supplier"))
    return raster.sampled(asked, cells, 0.0, 0.0, 25.0).select("id", F.round(F.col("z").cast("double") * 10).cast("int").alias("elev_dm"))


_TILES = "select l_linenumber as file_no, l_partkey % 40 as gi, cast(floor(l_partkey / 40.0) as bigint) as gj, case when l_quantity > 12 then l_quantity end as z from lineitem"


@query("dem_overlap", f"with c as ({_TILES}) select gi, gj, arg_min(z, file_no * 1000 + z) filter (where z is not null) as z from c group by gi, gj")
def dem_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that several files hold: the first file with a height there, the lower height where one file has two."""
    return raster.merged(spark.sql(_TILES.replace("from lineitem", "from {l}"), l=read(spark, sf_dir, "lineitem")))


@query("dem_tile_keys", _ND + "select id, cast(greatest(0, least(65535, floor((y - 7) / 4.0) + 1)) * 65536 + greatest(0, least(65535, floor((x - 9) / 3.0) + 1)) as bigint) as tile_key from lat_nodes")
def dem_tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", geo.raster_tile_key(F.col("x") - 9, F.col("y") - 7, 3, 4).cast("long").alias("tile_key"))


_CIRCLES = ", circles as (select id as circle, lat, lon, 120 + (id % 5) * 40.0 as radius from points)"


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).selectExpr("id as circle", "lat", "lon", "double(120 + (id % 5) * 40) as radius")


@query("edges_in_circles", WITH + _CIRCLES + """, q as (select circle, a, b, radius, (lon1 - lon) * cos(radians(lat)) * 111194.9 as ax, (lat1 - lat) * 111194.9 as ay, (lon2 - lon) * cos(radians(lat)) * 111194.9 as bx, (lat2 - lat) * 111194.9 as bky from circles, lat_edges),
t as (select *, greatest(0, least(1, -(ax * (bx - ax) + ay * (bky - ay)) / nullif(pow(bx - ax, 2) + pow(bky - ay, 2), 0))) as t from q)
select circle, a, b from t where sqrt(pow(ax + coalesce(t, 0) * (bx - ax), 2) + pow(ay + coalesce(t, 0) * (bky - ay), 2)) <= radius""")
def edges_in_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose straight line touches an avoided circle."""
    return areas.edges_touching(edges(spark, sf_dir), circles(spark, sf_dir)).select("circle", "a", "b")


@query("open_edges", WITH + _CIRCLES + """, q as (select a, b, radius, (lon1 - lon) * cos(radians(lat)) * 111194.9 as ax, (lat1 - lat) * 111194.9 as ay, (lon2 - lon) * cos(radians(lat)) * 111194.9 as bx, (lat2 - lat) * 111194.9 as bky from (select circle, lat, lon, radius / 6 as radius from circles), lat_edges),
t as (select *, greatest(0, least(1, -(ax * (bx - ax) + ay * (bky - ay)) / nullif(pow(bx - ax, 2) + pow(bky - ay, 2), 0))) as t from q),
shut as (select distinct a, b from t where sqrt(pow(ax + coalesce(t, 0) * (bx - ax), 2) + pow(ay + coalesce(t, 0) * (bky - ay), 2)) <= radius)
select a, b, (a + b) % 3 + 1 as modes, kind % 4 as flags from lat_edges anti join shut using (a, b) where ((a + b) % 3 + 1) & 1 <> 0 and (kind % 4) & 2 = 0""")
def open_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges a walker may take: open to the mode, without a skipped flag, outside a set of avoided circles."""
    every = edges(spark, sf_dir)
    shut = areas.edges_touching(every, circles(spark, sf_dir).withColumn("radius", F.col("radius") / 6))
    usable = every.select("a", "b", ((F.col("a") + F.col("b")) % 3 + 1).alias("modes"), (F.col("kind") % 4).alias("flags"))
    return areas.usable(usable, mode=1, skip=2).join(shut.select("a", "b").distinct(), ["a", "b"], "left_anti")


@query("nodes_in_areas", WITH + _CIRCLES + """select distinct n.id as node from lat_nodes n, circles c
where sqrt(pow((n.lon_e7 / 1e7 - c.lon) * cos(radians(c.lat)), 2) + pow(n.lat_e7 / 1e7 - c.lat, 2)) * 111194.9 <= c.radius""")
def nodes_in_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.inside(nodes(spark, sf_dir), circles(spark, sf_dir)).select("node").distinct()


@query("box_margins", WITH + """, box as (select min(lat_e7) / 1e7 as s, max(lat_e7) / 1e7 as n, min(lon_e7) / 1e7 as w, max(lon_e7) / 1e7 as e from lat_nodes)
select id, round(least(lat - s, n - lat, (lon - w) * cos(radians(lat)), (e - lon) * cos(radians(lat))) * 111194.9, 3) as margin from points, box""")
def box_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres of each point to the nearest side of the lattice's box; the box is one row."""
    box = nodes(spark, sf_dir).agg(*[f(c).alias(n) for f, c, n in ((F.min, "lat", "s"), (F.max, "lat", "n"), (F.min, "lon", "w"), (F.max, "lon", "e"))])
    margin = geo.box_margin(F.col("lat"), F.col("lon"), F.col("s"), F.col("w"), F.col("n"), F.col("e"))
    return points(spark, sf_dir).join(F.broadcast(box)).select("id", F.round(margin, 3).alias("margin"))


@query("circle_rings", WITH + _CIRCLES + """, i as (select unnest(range(0, 9)) as i) select circle, i, round(lon + radius * cos((i % 8) / 8.0 * 2 * pi()) / (111194.9 * cos(radians(lat))), 7) as lon,
round(lat + radius * sin((i % 8) / 8.0 * 2 * pi()) / 111194.9, 7) as lat from circles, i""")
def circle_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.circle_polygon(F.col("lat"), F.col("lon"), F.col("radius"), 8)
    return circles(spark, sf_dir).select("circle", F.posexplode(ring).alias("i", "p")).select("circle", F.col("i").cast("long").alias("i"), F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("fitted_radii", WITH + _CIRCLES + """, near as (select circle, radius * 4 as asked, min(sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)) * 111195) as metres
from circles a join points b on b.id in (a.circle + 1, a.circle + 2, a.circle + 3) group by circle, radius) select circle, cast(greatest(50, floor(least(asked, floor(metres) - 1) / 10) * 10) as bigint) as radius from near""")
def fitted_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest allowed radius of each circle beside the three points that follow it."""
    around = circles(spark, sf_dir).withColumn("id", F.explode(F.array(*[F.col("circle") + k for k in (1, 2, 3)])))
    near = around.join(points(spark, sf_dir).selectExpr("id", "lat as lat2", "lon as lon2"), "id")
    metres = geo.planar(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    closest = near.groupBy("circle", "radius").agg(F.min(metres).alias("metres"))
    return closest.select("circle", geo.fitted_radius(F.col("radius") * 4, F.col("metres")).cast("long").alias("radius"))


@query("covered_points", WITH + """, cells as (select distinct floor(lat_e7 / 1e4) as cy, floor(lon_e7 / 1e4) as cx from lat_nodes where elev_dm < 1300)
select id, exists(select 1 from cells where cy = floor(lat * 1000) and cx = floor(lon * 1000)) as covered from points""")
def covered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each point lies in a covered cell, its west and south sides included."""
    cells = nodes(spark, sf_dir).where("elev_dm < 1300").selectExpr("floor(lat_e7 / 1e4) as cy", "floor(lon_e7 / 1e4) as cx").distinct().withColumn("covered", F.lit(True))
    asked = points(spark, sf_dir).selectExpr("id", "floor(lat * 1000) as cy", "floor(lon * 1000) as cx")
    return asked.join(cells, ["cy", "cx"], "left").select("id", F.coalesce("covered", F.lit(False)).alias("covered"))


@query("veil_rectangles", _ND + """, cells as (select distinct x, y from lat_nodes where elev_dm < 1400), grid as (select x, y from lat_nodes), free as (select * from grid anti join cells using (x, y)),
r as (select *, x - row_number() over (partition by y order by x) as run from free), h as (select y, min(x) as x0, max(x) + 1 as x1 from r group by y, run),
v as (select *, y - row_number() over (partition by x0, x1 order by y) as run from h) select x0, x1, min(y) as y0, max(y) + 1 as y1 from v group by x0, x1, run""")
def veil_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered cells as rectangles: runs along a row, and runs of equal runs over rows."""
    free = nodes(spark, sf_dir).where("elev_dm >= 1400").select("x", "y")
    return areas.rectangles(free)


_N = 1 << 10


@query("tiles_covering", f"""with b as (select s_suppkey as id, 45 + (s_suppkey % 7) / 10.0 as south, 46 + (s_suppkey % 5) / 10.0 as north, 5 + (s_suppkey % 11) / 10.0 as west, 6.5 + (s_suppkey % 3) / 10.0 as east from supplier),
t as (select id, cast(floor((west + 180) / 360 * {_N}) as int) as x0, cast(floor((east + 180) / 360 * {_N}) as int) as x1, cast(floor((1 - asinh(tan(radians(north))) / pi()) / 2 * {_N}) as int) as y0, cast(floor((1 - asinh(tan(radians(south))) / pi()) / 2 * {_N}) as int) as y1 from b),
y as (select id, x0, x1, unnest(range(y0, y1 + 1)) as ty from t) select id, cast(unnest(range(x0, x1 + 1)) as int) as tx, cast(ty as int) as ty from y""")
def tiles_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "45 + (s_suppkey % 7) / 10 as south", "46 + (s_suppkey % 5) / 10 as north", "5 + (s_suppkey % 11) / 10 as west", "6.5D + (s_suppkey % 3) / 10 as east")
    (x0, y0), (x1, y1) = geo.web_tile(F.col("north"), F.col("west")), geo.web_tile(F.col("south"), F.col("east"))
    rows = boxes.select("id", x0.alias("x0"), x1.alias("x1"), F.explode(F.sequence(y0, y1)).alias("ty"))
    return rows.select("id", F.explode(F.sequence("x0", "x1")).alias("tx"), "ty")


@query("crow_flies", WITH + """, s as (select *, id % 10 as route, first_value(lat) over w as lat0, first_value(lon) over w as lon0 from points window w as (partition by id % 10 order by id)),
m as (select route, id, radians(lon - lon0) * 6371000 * cos(radians(lat0)) as x, radians(lat - lat0) * 6371000 as y from s),
l as (select route, x, y, coalesce(lag(x) over w, 0) as px, coalesce(lag(y) over w, 0) as py, lead(id) over w is null as last from m window w as (partition by route order by id))
select route, round(sum(sqrt(pow(x - px, 2) + pow(y - py, 2)) + case when last then sqrt(x * x + y * y) else 0 end), 2) as metres from l group by route""")
def crow_flies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight lines from each route's start through its points and back."""
    rows = points(spark, sf_dir).select((F.col("id") % 10).alias("route"), F.col("id").alias("pos"), "lat", "lon")
    return routes.crow_flies(rows).select("route", F.round("metres", 2).alias("metres"))
