"""The route queries over the driver's tables, each with its DuckDB oracle.

The tables stand in for a road network: parts are nodes of a lattice, line items are references of ways,
suppliers are points to look around, orders are candidate loops, events are requests. One SQL text defines each
derived table for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeloom.functions import geo, ways
from ridgeloom.operators import folds, graph, ranking, routes, searches, spatial
from ridgeloom.plans.registry import query
from ridgeloom.streaming import windows

NODES = """
select cast(p_partkey as int) as id, cast(p_partkey % 40 as int) as x, cast(floor(p_partkey / 40.0) as int) as y,
       cast(450000000 + 9000 * floor(p_partkey / 40.0) as int) as lat_e7, cast(60000000 + 12700 * (p_partkey % 40) as int) as lon_e7,
       cast(1000 + 10 * p_size as int) as elev_dm from part"""
EDGES = """
select a.id as a, b.id as b, a.lat_e7 / 1e7 as lat1, a.lon_e7 / 1e7 as lon1, b.lat_e7 / 1e7 as lat2, b.lon_e7 / 1e7 as lon2,
       (b.elev_dm - a.elev_dm) / 10.0 as dz, (a.id * 7 + b.id) % 15 as kind, cast((a.elev_dm + b.elev_dm) / 10 as int) % 4 as surf
from lat_nodes a join (select id - 1 as a_id, * from lat_nodes where x > 0 union all select id - 40 as a_id, * from lat_nodes) b on a.id = b.a_id"""
REFS = "select l_orderkey as way, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, cast(l_partkey as int) as node from lineitem"
POINTS = "select s_suppkey as id, 45.0 + (s_suppkey % 50) * 0.0009 as lat, 6.0 + (s_suppkey % 39) * 0.00127 + 0.0003 as lon from supplier"
LOOPS = "select o_orderkey as loop, o_custkey % 40 + 2 as target_km, sum(l_quantity) / 5 as km, sum(l_linenumber) * 10.0 as gain, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_custkey"
WITH = f"with lat_nodes as ({NODES}), lat_edges as ({EDGES}), refs as ({REFS}), points as ({POINTS}), loops as ({LOOPS}) "

_HAVERSINE = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin((radians({3}) - radians({2})) / 2), 2))))"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES.replace("from part", "from {part}"), part=read(spark, sf_dir, "part")).withColumns({"lat": F.col("lat_e7") / 1e7, "lon": F.col("lon_e7") / 1e7})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir)
    rows = spark.sql(EDGES.replace("lat_nodes", "{n}"), n=found.drop("lat", "lon"))
    return rows.withColumn("dz", F.col("dz").cast("double")).withColumn("len", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REFS.replace("from lineitem", "from {l}"), l=read(spark, sf_dir, "lineitem"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(POINTS.replace("from supplier", "from {s}"), s=read(spark, sf_dir, "supplier"))
    return rows.withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOOPS.replace("from orders join lineitem", "from {o} join {l}"), o=read(spark, sf_dir, "orders"), l=read(spark, sf_dir, "lineitem"))


_LEN = _HAVERSINE.format("lat1", "lat2", "lon1", "lon2")


def _price_values() -> tuple[str, str]:
    kinds = ", ".join(f"('{p}', {i}, {float(m[k])})" for k, p in enumerate(ways.PROFILES) for i, m in enumerate(ways.KINDS.values()))
    surfaces = ", ".join(f"('{p}', {i}, {float(m[k])})" for k, p in enumerate(ways.PROFILES) for i, m in enumerate(ways.SURFACES.values()))
    return kinds, surfaces


_KINDS, _SURFACES = _price_values()


@query("edge_costs", WITH + f""", k(profile, kind, km) as (values {_KINDS}), s(profile, surf, sm) as (values {_SURFACES})
select a, b, k.profile, round({_LEN} * km * sm + 8.0 * greatest(dz, 0.0), 3) as cost from lat_edges join k using (kind) join s on s.profile = k.profile and s.surf = lat_edges.surf""")
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ways.priced(edges(spark, sf_dir)).select("a", "b", "profile", F.round("cost", 3).alias("cost"))


@query("edge_length", WITH + f"select a, b, round({_LEN}, 3) as metres from lat_edges")
def edge_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("a", "b", F.round("len", 3).alias("metres"))


@query("edge_classes", WITH + """select a, b, kind in (0, 1, 3, 4, 6) as trail, case when surf = 0 then kind in (0, 3, 4) else surf >= 2 end as unpaved,
cast(least(a, b) as bigint) * 4294967296 + greatest(a, b) as pair from lat_edges""")
def edge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, surf = F.col("kind"), F.col("surf")
    return edges(spark, sf_dir).select("a", "b", ways.is_trail(kind).alias("trail"), ways.is_unpaved(kind, surf).alias("unpaved"), ways.pair_key(F.col("a"), F.col("b")).alias("pair"))


@query("node_degree", WITH + "select node, count(*) as degree from (select a as node from lat_edges union all select b from lat_edges) group by node")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.degree(edges(spark, sf_dir))


@query("node_bounds", WITH + "select min(lat_e7) as south, max(lat_e7) as north, min(lon_e7) as west, max(lon_e7) as east, count(*) as n from lat_nodes")
def node_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).agg(F.min("lat_e7").alias("south"), F.max("lat_e7").alias("north"), F.min("lon_e7").alias("west"), F.max("lon_e7").alias("east"), F.count("*").alias("n"))


@query("node_tiles", WITH + """select id, cast(floor((lon_e7 / 1e7 + 180) / 360 * 1024) as int) as tx,
cast(floor((1 - asinh(tan(radians(lat_e7 / 1e7))) / pi()) / 2 * 1024) as int) as ty from lat_nodes""")
def node_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ty = geo.web_tile(F.col("lat"), F.col("lon"))
    return nodes(spark, sf_dir).select("id", tx.alias("tx"), ty.alias("ty"))


@query("nodes_by_tile", WITH + """select tx, ty, count(*) as n, max(elev_dm) as top from (select elev_dm, cast(floor((lon_e7 / 1e7 + 180) / 360 * 1024) as int) as tx,
cast(floor((1 - asinh(tan(radians(lat_e7 / 1e7))) / pi()) / 2 * 1024) as int) as ty from lat_nodes) group by tx, ty""")
def nodes_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, ty = geo.web_tile(F.col("lat"), F.col("lon"))
    return nodes(spark, sf_dir).groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"), F.max("elev_dm").alias("top"))


@query("node_cells", WITH + "select id, cast(floor((lat_e7 - 450000000) / 20000.0) * 20 + floor((lon_e7 - 60000000) / 30000.0) as bigint) as cell, cast(floor(lat_e7 / 1e6) as int) as coarse from lat_nodes")
def node_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", geo.grid_cell(F.col("lat_e7"), F.col("lon_e7"), 450_000_000, 60_000_000, 20).alias("cell"), geo.coarse_cell(F.col("lat_e7")).alias("coarse"))


@query("coverage_cells", WITH + "select distinct cast(floor(lat_e7 / 1e6) as int) as cy, cast(floor(lon_e7 / 1e6) as int) as cx from lat_nodes")
def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(geo.coarse_cell(F.col("lat_e7")).alias("cy"), geo.coarse_cell(F.col("lon_e7")).alias("cx")).distinct()


_HILBERT = f"""with recursive lat_nodes as ({NODES}), h as (select id, 15 as k, 0::bigint as key, x::bigint as x, y::bigint as y from lat_nodes union all
select id, k - 1, key + s * s * (case when rx = 1 then 3 - ry else ry end), case when ry = 1 then lx when rx = 1 then s - 1 - ly else ly end, case when ry = 1 then ly when rx = 1 then s - 1 - lx else lx end
from (select *, x & (s - 1) as lx, y & (s - 1) as ly, case when x & s > 0 then 1 else 0 end as rx, case when y & s > 0 then 1 else 0 end as ry from (select *, (1::bigint << k) as s from h where k >= 0)))"""


@query("node_hilbert", _HILBERT + " select id, key from h where k = -1")
def node_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", geo.hilbert_key(F.col("x"), F.col("y")).alias("key"))


@query("node_mercator", WITH + """select id, round(radians(lon_e7 / 1e7) * 6378137, 2) as mx, round(ln(tan(pi() / 4 + radians(lat_e7 / 1e7) / 2)) * 6378137, 2) as my from lat_nodes""")
def node_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    mx, my = geo.web_mercator(F.col("lat"), F.col("lon"))
    return nodes(spark, sf_dir).select("id", F.round(mx, 2).alias("mx"), F.round(my, 2).alias("my"))


def _conic_sql() -> str:
    n, scale, e, lon0, pole = geo.lambert_constants()
    t = f"tan(pi() / 4 - radians(lat_e7 / 1e7) / 2) / pow((1 - {e!r} * sin(radians(lat_e7 / 1e7))) / (1 + {e!r} * sin(radians(lat_e7 / 1e7))), {e / 2!r})"
    return f"with lat_nodes as ({NODES}), r as (select id, {scale!r} * pow({t}, {n!r}) as rho, {n!r} * (radians(lon_e7 / 1e7) - {lon0!r}) as theta from lat_nodes) select id, round(700000 + rho * sin(theta), 2) as easting, round({pole!r} - rho * cos(theta), 2) as northing from r"


@query("node_lambert93", _conic_sql())
def node_lambert93(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = geo.lambert93(F.col("lat"), F.col("lon"))
    return nodes(spark, sf_dir).select("id", F.round(e, 2).alias("easting"), F.round(n, 2).alias("northing"))


@query("way_references", WITH + """select way, pos, node, elev_dm, (way, pos) = (first_way, first_pos) as first_ref from (select refs.*, elev_dm,
first_value(way) over w as first_way, first_value(pos) over w as first_pos from refs left join lat_nodes on node = id window w as (partition by node order by way, pos))""")
def way_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.refs_nodes(refs(spark, sf_dir), nodes(spark, sf_dir).select("id", "elev_dm")).select("way", "pos", "node", "elev_dm", "first_ref")


_STEPS = ", steps as (select * from (select way, pos, node as a, lead(node) over (partition by way order by pos) as b from refs) where b is not null and a <> b) "


@query("way_steps", WITH + _STEPS + "select way, pos, a, b from steps")
def way_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.steps(refs(spark, sf_dir))


@query("step_degree", WITH + _STEPS + "select node, count(*) as degree from (select a as node from steps union all select b from steps) group by node")
def step_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.degree(routes.steps(refs(spark, sf_dir)))


_WALK = ", walk as (select way as route, pos, lat_e7 / 1e7 as lat, lon_e7 / 1e7 as lon, elev_dm from refs join lat_nodes on node = id) "
_ALONG = ", seg as (select *, case when lag(lat) over w is null then 0 else " + _HAVERSINE.format("lag(lat) over w", "lat", "lag(lon) over w", "lon") + " end as seg from walk window w as (partition by route order by pos)) "


def walk(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Ways as routes: their references' positions, and further columns of nodes, in order.

    References meet their nodes before they are numbered, so that they are shuffled twice: by node, and then by way, where
    windows along a route find them. There a position is one number, and a node's further rows, where an id repeats, are a
    list beside its first."""
    spot = F.shiftleft(F.col("lat_e7").cast("long"), 32).bitwiseOR(F.col("lon_e7").cast("long").bitwiseAND(0xFFFFFFFF))
    at = F.struct("spot", *more)
    own = nodes(spark, sf_dir).withColumn("spot", spot).groupBy("id").agg(F.min(at).alias("own"), F.collect_list(at).alias("every"))
    found = own.select(F.col("id").alias("node"), "own.*", F.expr("case when size(every) > 1 then every end").alias("every"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), "l_linenumber", F.col("l_partkey").cast("int").alias("node"))
    pos = F.row_number().over(Window.partitionBy("route").orderBy("l_linenumber", "node"))
    placed = rows.join(found, "node", "left").withColumn("pos", pos).where("spot is not null")  # a reference without a node has a number too
    each = placed.select("node", "route", "pos", F.explode(F.coalesce("every", F.array(at))).alias("at")).select("node", "route", "pos", "at.*")
    lat, lon = F.shiftright("spot", 32), F.shiftright(F.shiftleft("spot", 32), 32)
    return each.select("node", "route", "pos", (lat / 1e7).alias("lat"), (lon / 1e7).alias("lon"), *more)


@query("route_distance", WITH + _WALK + _ALONG + "select route, pos, round(sum(seg) over (partition by route order by pos), 2) as metres from seg")
def route_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.running_distance(walk(spark, sf_dir)).select("route", "pos", F.round("metres", 2).alias("metres"))


@query("route_summary", WITH + _WALK + _ALONG + "select route, round(sum(seg), 2) as metres, min(elev_dm) as lowest, max(elev_dm) as highest, count(*) as n from seg group by route")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.running_distance(walk(spark, sf_dir, "elev_dm")).groupBy("route").agg(F.round(F.sum("seg"), 2).alias("metres"), F.min("elev_dm").alias("lowest"), F.max("elev_dm").alias("highest"), F.count("*").alias("n"))


@query("route_markers", WITH + _WALK + _ALONG + """, far as (select route, cast(floor(sum(seg) / 1000) as int) as whole from seg group by route)
select route, cast(unnest(range(1, whole + 1)) as int) as km from far where whole >= 1""")
def route_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = routes.running_distance(walk(spark, sf_dir)).groupBy("route").agg(F.floor(F.sum("seg") / 1000).cast("int").alias("whole")).where("whole >= 1")
    return far.select("route", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("km"))


@query("route_stretches", WITH + """, marked as (select *, case when row_number() over w > 1 and surf is not distinct from lag(surf) over w then 0 else 1 end as turned
from (select way, pos, node % 3 as surf from refs) window w as (partition by way order by pos)), runs as (select *, cast(sum(turned) over (partition by way order by pos) as int) as run from marked)
select way, run, surf, min(pos) as from_pos, max(pos) as to_pos, count(*) as n from runs group by way, run, surf""")
def route_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.stretches(refs(spark, sf_dir).withColumn("surf", F.col("node") % 3), "way", "pos", "surf")


@query("route_overlap", WITH + _STEPS + """, lap as (select a % 20 as route, way, pos, least(a % 50, b % 50) * 100 + greatest(a % 50, b % 50) as pair, abs(a - b) * 1.0 as len from steps),
r as (select *, row_number() over (partition by route, pair order by way * 10 + pos) as k from lap)
select route, sum(len) as metres, sum(case when k > 1 then len else 0 end) as repeated from r group by route""")
def route_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = routes.steps(refs(spark, sf_dir)).select(
        (a % 20).alias("route"), (F.col("way") * 10 + F.col("pos")).alias("at"), (F.least(a % 50, b % 50) * 100 + F.greatest(a % 50, b % 50)).alias("pair"), (F.abs(a - b) * 1.0).cast("double").alias("len")
    )
    return routes.repeated_metres(rows, "route", "at", "pair", "len")


_CLIMB = """list_reduce(list_prepend({{'up': 0.0::double, 'ref': {0}[1]}}, list_transform({0}, lambda q: {{'up': 0.0::double, 'ref': q}})),
lambda s, q: {{'up': s.up + case when abs(q.ref - s.ref) >= 2 then greatest(q.ref - s.ref, 0.0) else 0.0 end, 'ref': case when abs(q.ref - s.ref) >= 2 then q.ref else s.ref end}}).up"""


@query("route_climb", f"with h as (select l_suppkey as route, list(l_quantity order by l_orderkey, l_linenumber, l_quantity) as z from lineitem group by l_suppkey) select route, {_CLIMB.format('z')} as up, {_CLIMB.format('list_reverse(z)')} as down from h")
def route_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routes.ordered(read(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity", "z")
    return rows.select(F.col("l_suppkey").alias("route"), routes.climb(F.col("z")).alias("up"), routes.climb(F.reverse("z")).alias("down"))


@query("route_climb_blocks", f"with h as (select l_suppkey as route, list(l_quantity order by l_orderkey, l_linenumber, l_quantity) as z from lineitem group by l_suppkey) select route, {_CLIMB.format('z')} as up, {_CLIMB.format('list_reverse(z)')} as down from h")
def route_climb_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by blocks, for routes of any length; their order is a rank over the whole table."""
    order = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"]
    rows = read(spark, sf_dir, "lineitem").select(*order, F.lit(1).cast("long").alias("one"))
    ranked = graph.running_sums(rows, order, "one", "pos").select(F.col("l_suppkey").alias("route"), "pos", F.col("l_quantity").alias("z"))
    return folds.totals(ranked).select("route", "up", "down")


_PAIRS = f", pairs as (select points.id as point, lat_nodes.id as node, {_HAVERSINE.format('points.lat', 'lat_e7 / 1e7', 'points.lon', 'lon_e7 / 1e7')} as metres from points, lat_nodes) "


@query("nodes_within", WITH + _PAIRS + "select point, node, round(metres, 3) as metres from pairs where metres <= 400")
def nodes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within(points(spark, sf_dir), nodes(spark, sf_dir), 400.0).select("point", "node", F.round("metres", 3).alias("metres"))


@query("nearest_node", WITH + _PAIRS + "select point, node, round(metres, 3) as metres from (select *, row_number() over (partition by point order by metres, node) as k from pairs where metres <= 400) where k = 1")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest(points(spark, sf_dir), nodes(spark, sf_dir), 400.0).select("point", "node", F.round("metres", 3).alias("metres"))


#: Labels fall from node to node until none falls; a node keeps one row, the newest.
_COMPONENTS = "with recursive " + WITH.removeprefix("with ") + """, e as materialized (select a as u, b as v from lat_edges union select b, a from lat_edges),
r(node, component) using key (node) as (select u, least(u, min(v)) from e group by u union
select v, min(r.component) from r join e on u = r.node join recurring.r as known on known.node = v where r.component < known.component group by v)
select node, component, count(*) over (partition by component) as size from r"""


@query("components", _COMPONENTS)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over every edge of the lattice."""
    return graph.components(edges(spark, sf_dir).select("a", "b"))


@query("components_all", _COMPONENTS)
def components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under its earlier name."""
    return components(spark, sf_dir)


_ANY_KIND = ", ".join(f"({i}, {float(m[0])})" for i, m in enumerate(ways.KINDS.values()))
_ANY_SURFACE = ", ".join(f"({i}, {float(m[0])})" for i, m in enumerate(ways.SURFACES.values()))
#: Edges both ways with their cost in the profile for any surface.
PRICED = f""", kk(kind, km) as (values {_ANY_KIND}), ss(surf, sm) as (values {_ANY_SURFACE}), pr as (select a, b, {_LEN} * km * sm as m, dz from lat_edges join kk using (kind) join ss using (surf)),
links as (select a, b, m + 8.0 * greatest(dz, 0.0) as cost from pr union all select b, a, m + 8.0 * greatest(-dz, 0.0) from pr)"""
#: Costs fall from node to node until none falls; a node keeps one row.
_COSTS = "with recursive " + WITH.removeprefix("with ") + PRICED + """, r(node, cost) using key (node) as (select cast(0 as int), cast(0 as double) union
select x.b, x.cost from (select l.b, min(r.cost + l.cost) as cost from r join links l on l.a = r.node group by l.b) x left join recurring.r as known on known.node = x.b where known.cost is null or x.cost < known.cost - 1e-9)
select cast(0 as int) as source, node, round(cost, 3) as cost, cast(least(65535, floor(cost / 16)) as int) as units from r"""


@query("path_costs", _COSTS)
def path_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs from the first node to all that it reaches, both directions, in the profile for any surface."""
    priced = ways.priced(edges(spark, sf_dir)).where("profile = 'any'").select("a", "b", "cost", "dz")
    back = priced.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("cost") - 8 * F.greatest("dz", F.lit(0.0)) + 8 * F.greatest(-F.col("dz"), F.lit(0.0))).alias("cost"))
    found = searches.distances(priced.select("a", "b", "cost").union(back), spark.range(1).select(F.col("id").cast("int").alias("id")))
    return found.select("source", "node", F.round("cost", 3).alias("cost"), geo.quantized(F.col("cost")).alias("units"))


_TIERS = """case when abs(km - target_km) / target_km <= 0.10 then 'match' when abs(km - target_km) / target_km <= 0.25 then 'suggestion'
when abs(km - target_km) / target_km <= 0.35 then 'wide' else 'none' end as distance_tier,
case when abs(gain - target_km * 8.0) <= greatest(target_km * 8.0 * 0.2, 50.0) then 'match' when abs(gain - target_km * 8.0) <= greatest(target_km * 8.0 * 0.5, 100.0) then 'suggestion'
when abs(gain - target_km * 8.0) <= greatest(target_km * 8.0 * 0.75, 150.0) then 'wide' else 'none' end as gain_tier"""


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    km, target, gain = F.col("km").cast("double"), F.col("target_km").cast("double"), F.col("gain").cast("double")
    return loops(spark, sf_dir).select("loop", "target_km", routes.distance_tier(F.abs(km - target) / target).alias("distance_tier"), routes.gain_tier(F.abs(gain - target * 8.0), target * 8.0).alias("gain_tier"))


@query("rank_tiers", WITH + f"select loop, target_km, {_TIERS} from loops")
def rank_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir)


@query("rank_matches", WITH + f"select target_km, count(*) as loops, count(*) filter (where distance_tier = 'match' and gain_tier = 'match') as matches from (select target_km, {_TIERS} from loops) group by target_km")
def rank_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).groupBy("target_km").agg(F.count("*").alias("loops"), F.count_if((F.col("distance_tier") == "match") & (F.col("gain_tier") == "match")).alias("matches"))


@query("closest_gain", WITH + """, g as (select target_km, loop, cast(gain as double) as gain, target_km * 8.0 as target from loops)
select target_km, case when not bool_or(abs(gain - target) <= greatest(target * 0.2, 50)) then first(gain order by abs(gain - target), loop) end as gain from g group by target_km""")
def closest_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The climb nearest to each target, where no loop meets it."""
    rows = loops(spark, sf_dir).selectExpr("target_km", "loop", "double(gain) as gain", "target_km * 8D as target_gain")
    return ranking.closest_gain(rows, "target_km", "loop")


@query("closest_gain_by_customer", """with l as (select o_custkey, o_orderkey, sum(l_linenumber) * 10.0 as gain from orders join lineitem on o_orderkey = l_orderkey group by all), g as (select o_custkey as request, o_orderkey as loop, case when o_orderkey % 7 > 0 then cast(gain as double) end as gain, o_custkey % 2500 * 1.0 as target from l)
select request, case when not bool_or(coalesce(abs(gain - target) <= greatest(target * 0.2, 50), false)) then first(gain order by abs(gain - target), loop) filter (where gain is not null) end as gain from g group by request""")
def closest_gain_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the orders of each customer, some without a climb: most customers' targets are met by none."""
    rows = loops(spark, sf_dir).select("loop", F.when(F.col("loop") % 7 > 0, F.col("gain").cast("double")).alias("gain"))
    asked = read(spark, sf_dir, "orders").selectExpr("o_orderkey as loop", "o_custkey as request", "double(o_custkey % 2500) as target_gain")
    return ranking.closest_gain(rows.join(asked, "loop"), "request", "loop")


@query("rate_windows", "select cast(epoch_us(ts) // 600000000 * 600 as bigint) as start, user_id, count(*) as n from events group by 1, 2")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(read(spark, sf_dir, "events"), "user_id")


@query("rate_admitted", "select event_id, row_number() over (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id) <= 2 as admitted from events")
def rate_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.admitted(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, 86_400).select("event_id", "admitted")


@query("high_points", f"""with lat_nodes as ({NODES}), p as (select id, elev_dm / 10.0 as elev, (lon_e7 / 1e7 - 6.02) * cos(radians(45.01)) * 111195.0 as x, (lat_e7 / 1e7 - 45.01) * 111195.0 as y from lat_nodes),
s as (select *, case when sqrt(x * x + y * y) < 2000 then 0 else 1 end as ring, cast(floor((atan2(y, x) + 3.141592653589793) / (2 * 3.141592653589793) * 12) as int) % 12 as sector from p where sqrt(x * x + y * y) <= 4000)
select ring, sector, arg_max(id, elev * 10000000.0 - id) as id, max(elev) as elev from s group by ring, sector""")
def high_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.highest_by_sector(nodes(spark, sf_dir).withColumn("elev", F.col("elev_dm") / 10), 45.01, 6.02, 4000.0)
