"""Queries that write the text formats and read them back; what comes back must be the rows that SQL has without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.plans.catalog import _WALK, NODES, WITH, nodes, read, walk
from ridgeloom.plans.registry import query
from ridgeloom.sources import grids, tiles, tracks


@query("gpx_round_trip", WITH + _WALK + ", n as (select route, pos, round(lon, 6) as lon, round(lat, 6) as lat, case when route % 3 > 0 then elev_dm / 10.0 end as ele, row_number() over (partition by route order by pos) - 1 as place from walk) select route, place, lon, lat, round(ele, 1) as ele from n")
def gpx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route written as a GPX document and read back."""
    rows = walk(spark, sf_dir, "elev_dm").select("route", F.struct("pos", "lon", "lat", F.when(F.col("route") % 3 > 0, F.col("elev_dm") / 10).alias("ele")).alias("p"))
    lists = rows.groupBy("route").agg(F.array_sort(F.collect_list("p")).alias("track"))
    written = lists.select("route", tracks.document(F.concat(F.lit("<Route> & "), F.col("route").cast("string")), F.col("track")).alias("body"))
    return written.select("route", F.posexplode(tracks.points(F.col("body"))).alias("place", "p")).select("route", F.col("place").cast("long").alias("place"), "p.lon", "p.lat", "p.ele")


@query("grid_round_trip", f"with lat_nodes as ({NODES}) select cast(floor(y / 10.0) as int) as tile, cast(x as bigint) as gi, cast(y as bigint) as gj, case when elev_dm >= 1020 then elev_dm / 10.0 end as z from lat_nodes")
def grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice written as grids of ten rows and read back, low heights as no data."""
    band = F.floor(F.col("y") / 10).cast("int")
    z = F.when(F.col("elev_dm") >= 1020, F.col("elev_dm") / 10)
    rows = nodes(spark, sf_dir).select(band.alias("tile"), F.struct((-F.col("y")).alias("north"), "x", z.alias("z")).alias("c"), "y")
    lists = rows.groupBy("tile").agg(F.array_sort(F.collect_list("c")).alias("cells"), F.countDistinct("y").cast("int").alias("nrows"))
    size = F.lit(25.0)
    body = grids.body(F.lit(40), F.col("nrows"), F.lit(100.0), F.col("tile") * 250.0, size, F.transform("cells", lambda c: c["z"]))
    found = grids.cells(grids.grids(lists.select(F.col("tile").cast("string").alias("path"), body.alias("body"))))
    return found.select(F.col("path").cast("int").alias("tile"), "gi", "gj", "z")


_BODY = """'{"cells":[[' || (p_partkey % 9) || ',' || (p_size % 7) || ',' || (p_partkey % 5 + 4) || ',' || (p_size % 4 + 3) || '],[1,2,3,4]]}'"""


@query("coverage_json", "with c as (select p_partkey as id, p_partkey % 9 as west, p_size % 7 as south, p_partkey % 5 + 4 as east, p_size % 4 + 3 as north from part) select id, cast(west as double) as west, cast(south as double) as south, cast(east as double) as east, cast(north as double) as north from c where west < east and south < north union all select id, 1.0::double, 2.0::double, 3.0::double, 4.0::double from c where west < east and south < north")
def coverage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of coverage bodies whose every cell has an area."""
    bodies = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_BODY).alias("body"))
    return bodies.select("id", F.explode(tiles.coverage(F.col("body"))).alias("c")).select("id", "c.*")


_POIS = """'{"pois":[{"category":"' || case p_size % 4 when 0 then 'water' when 1 then 'viewpoint' when 2 then 'toilets' else 'bench' end || '","position":[' || p_size || '.5,' || p_partkey || ']' ||
case when p_size % 2 = 0 then ',"seasonal":true' else '' end || ',"name":"n' || p_partkey || '"},{"category":"water","position":[1]},{"category":"water"},7,null,"x",[1],{"category":5,"position":[1,2]},{"category":"water","position":["1","2"]},{"category":"water","position":[1,null]},{"category":"toilets","position":[1,2,3]},{"category":"water","position":[-' || p_size || ',2e0],"seasonal":"true","name":""}]}'"""


@query("tile_points_json", "select p_partkey as id, case p_size % 4 when 0 then 'water' when 1 then 'viewpoint' else 'toilets' end as category, p_size + 0.5::double as lon, cast(p_partkey as double) as lat, p_size % 2 = 0 as seasonal, 'n' || p_partkey as name from part where p_size % 4 < 3 union all select p_partkey, 'water', -p_size::double, 2.0::double, false, null from part")
def tile_points_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed points of tile bodies; others of the same body are left out one by one."""
    bodies = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_POIS).alias("body"))
    return bodies.select("id", F.explode(tiles.points(F.col("body"))).alias("p")).select("id", "p.*")


_PLACES = """'{"features":[' || array_join(transform(sequence(1, 7), k -> '{"geometry":{"coordinates":[' || (p_size + k) || ',' || (case when (p_partkey + k) % 3 = 0 then 'null' else '4.5' end) || ']},"properties":{"' ||
(case (p_partkey + k) % 4 when 0 then 'name' when 1 then 'toponym' when 2 then 'label' else 'other' end) || '":"p' || k || '"}}'), ',') || ']}'"""


@query("places_json", """with k as (select p_partkey, p_size, unnest(range(1, 8)) as k from part), g as (select *, row_number() over (partition by p_partkey order by k) as n from k where (p_partkey + k) % 3 <> 0 and (p_partkey + k) % 4 < 3)
select p_partkey as id, cast(n - 1 as bigint) as place, cast(p_size + k as double) as lon, 4.5::double as lat, 'p' || k as label from g where n <= 5""")
def places_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five places of each answer that have a position and a label."""
    bodies = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_PLACES).alias("body"))
    return bodies.select("id", F.posexplode(tiles.places(F.col("body"))).alias("place", "p")).select("id", F.col("place").cast("long").alias("place"), "p.*")
