"""Queries over a map extract that is written from the tables: parts are its nodes, line items the references of its ways."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.functions import tags
from ridgeloom.operators import extracts as graph_of
from ridgeloom.plans.catalog import NODES, nodes, read
from ridgeloom.plans.registry import query
from ridgeloom.scratch import folder
from ridgeloom.sources import extracts

_HIGHWAYS = ("path", "footway", "track", "residential", "motorway", "primary", "construction")
_WAY_TAGS = "map('highway', element_at(array({0}), cast(l_orderkey % {1} as int) + 1), 'name', concat('Rue é ', l_orderkey))".format(", ".join(f"'{h}'" for h in _HIGHWAYS), len(_HIGHWAYS))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes, some with tags, and orders as ways over their parts, two of them with a node that the extract lacks."""
    found = nodes(spark, sf_dir).join(read(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as id", "p_name", "p_size"), "id")
    named = F.when(F.col("p_size") % 3 == 0, F.expr("map('name', p_name, 'natural', 'peak')"))
    points = found.select(F.lit("node").alias("kind"), F.col("id").cast("long").alias("id"), "lat", "lon", named.alias("tags"), F.lit(None).cast("array<bigint>").alias("refs"))
    ref = F.when((F.col("l_orderkey") % 50 == 7) & (F.col("l_linenumber") == 2), F.lit(10**12)).otherwise(F.col("l_partkey"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", ref.alias("ref")).alias("r"))
    ways = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["ref"]).alias("refs"))  # the lines of an order
    lines = ways.select(F.lit("way").alias("kind"), F.col("l_orderkey").cast("long").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.expr(_WAY_TAGS).alias("tags"), "refs")
    return points.unionByName(lines)


def extract(spark: SparkSession, sf_dir: str) -> str:
    """The folder of an extract of these entities, written by Spark."""
    extracts.register(spark)
    path = f"{folder(spark)}/extract-{uuid.uuid4().hex}"
    entities(spark, sf_dir).write.format("mapextract").mode("append").save(path)
    return path


_ENTITIES = f"""with lat_nodes as ({NODES}), refs as (select l_orderkey as way, list(case when l_orderkey % 50 = 7 and l_linenumber = 2 then 1000000000000 else l_partkey end order by l_linenumber, l_partkey) as refs from lineitem group by 1),
hw as (select way, refs, ([{', '.join(f"'{h}'" for h in _HIGHWAYS)}])[way % {len(_HIGHWAYS)} + 1] as highway from refs)"""


@query("extract_round_trip", _ENTITIES + """ select 'node' as kind, cast(id as bigint) as id, lat_e7 / 1e7 as lat, lon_e7 / 1e7 as lon, case when p_size % 3 = 0 then 'name=' || p_name || ';natural=peak' else '' end as tags, cast(null as varchar) as refs from lat_nodes join part on p_partkey = id
union all select 'way', way, null, null, 'highway=' || highway || ';name=Rue é ' || way, array_to_string(refs, ',') from hw""")
def extract_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node and way of the extract as the data source reads it."""
    rows = spark.read.format("mapextract").load(extract(spark, sf_dir))
    words = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select("kind", "id", "lat", "lon", words.alias("tags"), F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query("extract_edges", _ENTITIES + f""", open as (select way, refs, highway from hw where highway in ('path', 'footway', 'track', 'residential', 'primary') and len(refs) > 1),
r as (select way, unnest(range(1, len(refs) + 1)) as pos, unnest(refs) as node from open), p as (select r.way, r.pos, r.node, lat_e7, lon_e7, elev_dm from r join lat_nodes on id = node),
s as (select a.way, a.node as a, b.node as b from p a join p b on a.way = b.way and b.pos = a.pos + 1 where a.node <> b.node),
k as (select a as node from s union select b from s), n as (select node, row_number() over (order by node) - 1 as place from k)
select s.way, x.place as a, y.place as b, s.a as a_id, s.b as b_id from s join n x on x.node = s.a join n y on y.node = s.b""")
def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of walkable ways between the nodes that have an edge, by the nodes' places among these."""
    path = extract(spark, sf_dir)
    source = lambda kind: spark.read.format("mapextract").option("kinds", kind).load(path)
    ways = graph_of.walkable(source("way"), tags.classify_way)
    steps = graph_of.steps_between_known(ways, source("node"))
    return graph_of.placed(steps).select("way", "a", "b", "a_id", "b_id")
