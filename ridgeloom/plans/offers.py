"""Queries that rank candidate loops (orders) and query the graph's order and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeloom.functions import geo
from ridgeloom.operators import graph, ranking, routes
from ridgeloom.plans.catalog import _HILBERT, _LEN, NODES, WITH, edges, loops, nodes, read, refs
from ridgeloom.plans.registry import query

_CANDIDATES = """, cand as (select loop, cast(km as double) as km, cast(target_km as double) as target_km, cast(gain as double) as gain, target_km * 8.0 as target_gain,
(loop % 11) / 10.0 as unpaved, (loop % 7) / 20.0 as retrace, loop % 17 = 3 as direct from loops),
chk as (select *, case when abs(km - target_km) <= 0.1 * target_km then 0 when abs(km - target_km) <= 0.25 * target_km then 1 when abs(km - target_km) <= 0.35 * target_km then 2 when direct and km > target_km then 2 else 3 end as far,
case when abs(gain - target_gain) <= greatest(0.2 * target_gain, 50) then 0 when abs(gain - target_gain) <= greatest(0.5 * target_gain, 100) then 1 else 2 end as high,
abs(km - target_km) / target_km + 3 * abs(gain - target_gain) / greatest(target_gain, 250) + (1 - unpaved) + case when direct then 0 else retrace end as score from cand),
ranked as (select loop, target_km, score, greatest(far, high) as tier, case when greatest(far, high) = 0 then 'match' else 'suggestion' end as kind from chk where far < 3)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loops(spark, sf_dir).selectExpr(
        "loop", "double(km) as km", "double(target_km) as target_km", "double(gain) as gain", "target_km * 8D as target_gain", "'unpaved' as surface",
        "(loop % 11) / 10 as unpaved", "(loop % 7) / 20 as retrace", "loop % 17 = 3 as direct",
    )


@query("rank_classify", WITH + _CANDIDATES + " select loop, target_km, round(score, 9) as score, tier, kind from ranked")
def rank_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.classified(candidates(spark, sf_dir)).select("loop", "target_km", F.round("score", 9).alias("score"), "tier", "kind")


_REQUESTS = """, req as (select loop, cast(km as double) as km, case when loop % 5 > 0 then cast(gain as double) end as gain, case when loop % 3 > 0 then cast(target_km as double) end as target_km,
case when loop % 3 = 0 then target_km * 9.0 end as minutes, 6.0 + loop % 3 as pace, km * (1 + (loop % 4) / 20.0) as effort_km, case when loop % 8 < 4 then target_km * 8.0 end as target_gain,
case when loop % 8 = 5 then 'flat' when loop % 8 = 6 then 'hilly' end as level, case loop % 4 when 0 then 'paved' when 1 then 'unpaved' else 'any' end as surface,
(loop % 11) / 10.0 as unpaved, (loop % 7) / 20.0 as retrace, loop % 17 = 3 as direct, loop % 19 = 4 as lollipop from loops),
m as (select *, case when target_km is not null then km else effort_km * pace end as length, coalesce(target_km, minutes) as target, gain is not null and (level is not null or target_gain is not null) as climbs from req),
n as (select *, case when abs(length - target) <= 0.1 * target then 0 when abs(length - target) <= 0.25 * target then 1 when abs(length - target) <= 0.35 * target then 2 else 3 end as far, direct and length - target > 0.35 * target as beyond,
case when not climbs then 0 when level = 'flat' then case when gain / km <= 10 then 0 when gain / km <= 20 then 1 else 3 end when level = 'hilly' then case when gain / km >= 10 then 0 when gain / km >= 5 then 1 else 3 end
when abs(gain - target_gain) <= greatest(0.2 * target_gain, 50) then 0 when abs(gain - target_gain) <= greatest(0.5 * target_gain, 100) then 1 else 2 end as high,
case when not climbs then 0 when level = 'flat' then greatest(0, gain - 10 * km) / (10 * km) when level = 'hilly' then greatest(0, 10 * km - gain) / (10 * km) else 3 * abs(gain - target_gain) / greatest(target_gain, 250) end as more from m),
o as (select loop, abs(length - target) / target + more + case surface when 'unpaved' then 1 - unpaved when 'paved' then unpaved else 0 end + case when direct or lollipop then 0 else retrace end as score,
greatest(case when far = 3 and beyond then 2 else far end, case when high = 3 and beyond then 2 else high end) as tier from n)"""


@query("rank_requests", WITH + _REQUESTS + " select loop, round(score, 9) as score, tier, case when tier = 0 then 'match' else 'suggestion' end as kind from o where tier < 3")
def rank_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops against requests of every kind: by distance or duration, with a climb, a level or neither, some without heights."""
    rows = loops(spark, sf_dir).selectExpr(
        "loop", "double(km) as km", "case when loop % 5 > 0 then double(gain) end as gain", "case when loop % 3 > 0 then double(target_km) end as target_km", "case when loop % 3 = 0 then target_km * 9D end as minutes",
        "6D + loop % 3 as pace", "double(km) * (1 + (loop % 4) / 20) as effort_km", "case when loop % 8 < 4 then target_km * 8D end as target_gain", "case when loop % 8 = 5 then 'flat' when loop % 8 = 6 then 'hilly' end as level",
        "case loop % 4 when 0 then 'paved' when 1 then 'unpaved' else 'any' end as surface", "(loop % 11) / 10 as unpaved", "(loop % 7) / 20 as retrace", "loop % 17 = 3 as direct", "loop % 19 = 4 as lollipop",
    )
    return ranking.classified(rows).select("loop", F.round("score", 9).alias("score"), "tier", "kind")


@query("rank_candidates", WITH + _CANDIDATES + " select loop, target_km, row_number() over (partition by target_km order by round(score, 9), loop) as place from ranked")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each request in the order of their scores, earlier ones first on ties."""
    order = Window.partitionBy("target_km").orderBy("score", "loop")
    return ranking.classified(candidates(spark, sf_dir)).select("loop", "target_km", F.round("score", 9).alias("score")).select("loop", "target_km", F.row_number().over(order).cast("long").alias("place"))


@query("rank_levels", WITH + _CANDIDATES + """ select loop, case when gain / km <= 10 then 0 when gain / km <= 20 then 1 else 3 end as flat_tier, round(greatest(0, gain - 10 * km) / (10 * km), 9) as flat_gap,
case when gain / km >= 10 then 0 when gain / km >= 5 then 1 else 3 end as hilly_tier, round(greatest(0, 10 * km - gain) / (10 * km), 9) as hilly_gap from cand""")
def rank_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    (flat, flat_gap), (hilly, hilly_gap) = (ranking.level_check(F.col("km"), F.col("gain"), h) for h in (False, True))
    return candidates(spark, sf_dir).select("loop", flat.alias("flat_tier"), F.round(flat_gap, 9).alias("flat_gap"), hilly.alias("hilly_tier"), F.round(hilly_gap, 9).alias("hilly_gap"))


@query("rank_best_laps", WITH + _CANDIDATES + """, lap as (select *, unnest(range(1, greatest(1, least(10, cast(floor(50 / km) as bigint))) + 1)) as laps from cand), r as (select loop, laps, km * laps as km, gain * laps as gain, target_km, target_gain, unpaved from lap),
t as (select loop, laps, case when abs(km - target_km) <= 0.1 * target_km then 0 when abs(km - target_km) <= 0.25 * target_km then 1 when abs(km - target_km) <= 0.35 * target_km or km > target_km then 2 else 3 end as far,
case when abs(gain - target_gain) <= greatest(0.2 * target_gain, 50) then 0 when abs(gain - target_gain) <= greatest(0.5 * target_gain, 100) then 1 else 2 end as high,
abs(km - target_km) / target_km + 3 * abs(gain - target_gain) / greatest(target_gain, 250) + (1 - unpaved) as score from r),
o as (select loop, laps, row_number() over (partition by loop order by greatest(far, high), score, laps) as k from t where far < 3) select loop, cast(laps as int) as laps from o where k = 1""")
def rank_best_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_laps(candidates(spark, sf_dir))


@query("target_distances", """with q as (select o_orderkey as request, case when o_orderkey % 3 = 0 then o_orderkey % 49 + 2.0 end as distance, o_custkey % 340 + 15.0 as minutes, o_custkey % 9 + 3.0 as pace, case when o_orderkey % 5 = 1 then o_custkey % 2500 * 1.0 end as gain, o_orderkey % 5 = 2 as hilly from orders),
e as (select *, minutes / pace as effort from q), f as (select *, case when hilly then effort / (1 + 10 / 400.0) else effort - coalesce(gain, 0) / 400 end as found from e)
select request, round(coalesce(distance, case when found >= 2 then found end), 6) as km from f""")
def target_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "orders").selectExpr("o_orderkey as request", "case when o_orderkey % 3 = 0 then double(o_orderkey % 49 + 2) end as distance", "double(o_custkey % 340 + 15) as minutes", "double(o_custkey % 9 + 3) as pace", "case when o_orderkey % 5 = 1 then double(o_custkey % 2500) end as gain", "o_orderkey % 5 = 2 as hilly")
    return q.select("request", F.round(ranking.target_km(*map(F.col, ("distance", "minutes", "pace", "gain", "hilly"))), 6).alias("km"))


@query("rank_pick")
def rank_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes offered for each target: best first, none that covers another's ground."""
    ranked = ranking.classified(candidates(spark, sf_dir)).withColumn("direct", F.col("direct") & (F.col("loop") % 4 == 0))
    ground = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("loop")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 20)).alias("cells"))
    rows = ranked.join(ground, "loop").select((F.col("target_km") * 1000 + F.col("loop") % 25).cast("long").alias("request"), F.col("loop").alias("id"), F.round("score", 9).alias("score"), "tier", "direct", "cells")
    return ranking.picked(rows)


@query("avoided_costs", WITH + f", e as (select a, b, {_LEN} as m, (a * 13 + b) % 9 = 0 as walked from lat_edges) select a, b, round(m * case when walked then 6 else 1 end, 3) as cost from e")
def avoided_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with those of earlier legs made six times as dear."""
    rows = edges(spark, sf_dir).select("a", "b", F.col("len").alias("cost"), F.struct("a", "b").alias("pair"))
    return ranking.avoided(rows, rows.where((F.col("a") * 13 + F.col("b")) % 9 == 0)).select("a", "b", F.round("cost", 3).alias("cost"))


@query("reversed_stretches", WITH + """, m as (select way, pos, node % 3 as surf, case when row_number() over w > 1 and node % 3 = lag(node % 3) over w then 0 else 1 end as turned from refs window w as (partition by way order by pos)),
r as (select *, sum(turned) over (partition by way order by pos) as run from m), s as (select way, run, surf, min(pos) - 1 as f, max(pos) as t from r group by way, run, surf),
x as (select *, max(t) over (partition by way) as total from s) select way, cast(row_number() over (partition by way order by run desc) as int) as run, surf, total - t as from_pos, total - f as to_pos from x""")
def reversed_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each route walked the other way."""
    runs = routes.stretches(refs(spark, sf_dir).withColumn("surf", F.col("node") % 3), "way", "pos", "surf")
    total, turned = F.max("to_pos").over(Window.partitionBy("way")), F.row_number().over(Window.partitionBy("way").orderBy(F.desc("run")))
    rows = runs.withColumns({"total": total, "turned": turned})
    return rows.selectExpr("way", "turned as run", "surf", "bigint(total - to_pos) as from_pos", "bigint(total - from_pos + 1) as to_pos")


@query("repeated_stretches", WITH + """, l as (select way, max(pos) as total, cast(way % 3 + 1 as bigint) as laps from refs group by way), n as (select *, unnest(range(0, laps)) as lap from l)
select way, lap + 1 as lap, pos + lap * total as pos, node from n join refs using (way)""")
def repeated_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route walked so many laps, its positions running on."""
    rows = refs(spark, sf_dir)
    laps = rows.groupBy("way").agg(F.max("pos").alias("total")).withColumn("lap", F.explode(F.sequence(F.lit(1).cast("long"), F.col("way") % 3 + 1)))
    return rows.join(laps, "way").select("way", "lap", (F.col("pos") + (F.col("lap") - 1) * F.col("total")).alias("pos"), "node")


@query("csr_offsets", WITH + ", d as (select node, count(*) as degree from (select a as node from lat_edges union all select b from lat_edges) group by node) select node, degree, cast(sum(degree) over (order by node) - degree as bigint) as start from d")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node's edges start when they stand in the order of nodes."""
    return graph.running_sums(routes.degree(edges(spark, sf_dir)), ["node"], "degree", "start")


@query("hilbert_ranks", _HILBERT + " select id, row_number() over (order by key, id) - 1 as place from h where k = -1")
def hilbert_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each node along the Hilbert curve, without a sort in one task."""
    keyed = nodes(spark, sf_dir).select("id", geo.hilbert_key(F.col("x"), F.col("y")).alias("key"), F.lit(1).cast("long").alias("one"))
    return graph.running_sums(keyed, ["key", "id"], "one", "place").select("id", "place")


_MARKS = f"""with lat_nodes as ({NODES}), box as (select (min(lat_e7) / 1e7 + max(lat_e7) / 1e7) / 2 as lat0, (max(lat_e7) / 1e7 - min(lat_e7) / 1e7) / 2 as tall, (min(lon_e7) / 1e7 + max(lon_e7) / 1e7) / 2 as lon0, (max(lon_e7) / 1e7 - min(lon_e7) / 1e7) / 2 as wide from lat_nodes),
aim as (select cast(m as int) as mark, lat0 + 0.95 * tall * sin(2 * pi() * m / 8) as mlat, lon0 + 0.95 * wide * cos(2 * pi() * m / 8) as mlon from box, range(0, 8) t(m)),
gap as (select mark, id, round(pow((lon_e7 / 1e7 - mlon) * cos(radians(mlat)), 2) + pow(lat_e7 / 1e7 - mlat, 2), 15) as gap from lat_nodes, aim),
marks as (select mark, id as node from (select *, row_number() over (partition by mark order by gap, id) as k from gap) where k = 1)"""


@query("landmarks", _MARKS + " select mark, node from marks")
def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.landmarks(nodes(spark, sf_dir))


@query("landmark_bounds", _MARKS + """, far as (select n.id, mark, cast(floor(sqrt(pow(n.x - m.x, 2) + pow(n.y - m.y, 2)) * 100 / 16) as int) as units from lat_nodes n, marks join lat_nodes m on m.id = marks.node)
select a.id, greatest(0, max(abs(a.units - b.units) - 1)) * 16 as bound from far a join far b on a.mark = b.mark and b.id = a.id + 83 group by a.id""")
def landmark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bound on the way from each node to one across the lattice, by straight lines to the landmarks."""
    rows = nodes(spark, sf_dir).select("id", "x", "y")
    marks = graph.landmarks(nodes(spark, sf_dir)).join(rows.selectExpr("id as node", "x as mx", "y as my"), "node").select("mark", "mx", "my")
    units = F.floor(F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)) * 100 / 16).cast("int")
    held = F.transform(F.array_sort(F.collect_list(F.struct("mark", units.alias("u")))), lambda s: s["u"])
    far = rows.join(F.broadcast(marks)).groupBy("id").agg(held.alias("units"))
    both = far.join(far.selectExpr("id - 83 as id", "units as other"), "id")
    return both.select("id", graph.landmark_bound("units", "other").alias("bound"))


@query("union_extracts", """with f as (select 1 as file_no, l_partkey as id, l_quantity as v from lineitem where l_quantity < 30 union all select 2, l_partkey, l_quantity from lineitem where l_quantity > 20)
select id, file_no, v from (select *, row_number() over (partition by id order by file_no, v) as k from f) where k = 1""")
def union_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of overlapping extracts, each from the first file that has it: a partial minimum by id."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("v"))
    both = rows.where("v < 30").withColumn("file_no", F.lit(1)).unionByName(rows.where("v > 20").withColumn("file_no", F.lit(2)))
    return both.groupBy("id").agg(F.min(F.struct("file_no", "v")).alias("o")).select("id", "o.file_no", "o.v")
