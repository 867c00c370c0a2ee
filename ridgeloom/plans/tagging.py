"""Queries over tagged ways and points: parts stand for objects whose tags follow from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.functions import tags
from ridgeloom.functions.ways import KINDS, SURFACES
from ridgeloom.plans.catalog import read
from ridgeloom.plans.registry import query


def _pick(values: list[str | None], by: str) -> str:
    """SQL that deals the values out by a key."""
    return f"case ({by}) % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values) if v is not None) + " end"


_ACCESS = [None, "yes", "no", "private", "designated", "permissive", None]
_COLUMNS = {
    "highway": _pick([*tags.HIGHWAYS, "motorway", None], "p_partkey"),
    "surface": _pick([*" ".join(tags.SURFACE_VALUES.values()).split(), "dirt;sand", None, None], "p_partkey * 5 + p_size"),
    "area": _pick(["yes", *[None] * 12], "p_partkey + p_size"),
    "access": _pick([*_ACCESS, None, None, "customers"], "p_partkey * 3 + p_size"),
    "foot": _pick(_ACCESS, "p_partkey * 11 + p_size * 2"),
    "bicycle": _pick([*_ACCESS, "dismount"], "p_partkey * 13 + p_size * 3"),
    "motorroad": _pick(["yes", *[None] * 8], "p_partkey * 2 + p_size"),
    "oneway": _pick([None, "yes", "true", "1", "-1", "reverse", "no"], "p_partkey * 17 + p_size"),
    "oneway:bicycle": _pick([None, None, "yes", "-1", "no", None], "p_partkey * 19 + p_size * 5"),
    "cycleway:forward": _pick(["opposite_lane", None, "lane", None, None], "p_partkey + p_size * 7"),
    "cycleway:backward": _pick(["opposite", None, "lane", None, None, None], "p_partkey + p_size * 11"),
    "sac_scale": _pick([None, "hiking", "hiking; demanding_mountain_hiking", "alpine_hiking", "demanding_mountain_hiking", None, None], "p_partkey * 23 + p_size"),
    "mtb:scale": _pick([None, "0", "2;3", "4", " 5", "1", None, None], "p_partkey * 29 + p_size"),
    "amenity": _pick(["drinking_water", "toilets", None, "cafe"], "p_partkey * 7 + p_size"),
    "drinking_water": _pick([None, "yes", "no", None, None], "p_partkey * 31 + p_size"),
    "seasonal": _pick([None, "no", "summer", "yes"], "p_partkey * 37 + p_size"),
    "tourism": _pick([None, "viewpoint", None], "p_partkey * 41 + p_size"),
}
_TAGGED = "select p_partkey as id, " + ", ".join(f'{sql} as "{name}"' for name, sql in _COLUMNS.items()) + " from part"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the map of its tags; a missing tag is no entry."""
    each = F.array(*[F.struct(F.lit(n).alias("key"), F.expr(sql).alias("value")) for n, sql in _COLUMNS.items()])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.map_from_entries(F.filter(each, lambda e: e["value"].isNotNull())).alias("tags"))


def _words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _listed(column: str, values) -> str:
    return f"len(list_filter(string_split(coalesce(\"{column}\", ''), ';'), lambda x: trim(x) in {_words(values)})) > 0"


_KIND_ROWS = ", ".join(f"('{v}', {list(KINDS).index(k)})" for v, k in tags.HIGHWAYS.items())
_SURFACE_ROWS = ", ".join(f"('{v}', {list(SURFACES).index(g)})" for g, values in tags.SURFACE_VALUES.items() for v in values.split())
_RAW = f"with raw as ({_TAGGED}), t as (select id, highway, surface, " + ", ".join(f"coalesce(\"{c}\", '') as \"{c}\"" for c in _COLUMNS if c not in ("highway", "surface")) + " from raw)"
_DIRECTIONS = """, d as (select *, ("cycleway:forward" like 'opposite%' or case "oneway:bicycle" when 'yes' then true when 'true' then true when '1' then true
 when '-1' then false when 'reverse' then false when 'no' then true else oneway not in ('-1', 'reverse') end) as forward,
("cycleway:backward" like 'opposite%' or case "oneway:bicycle" when 'yes' then false when 'true' then false when '1' then false
 when '-1' then true when 'reverse' then true when 'no' then true else oneway not in ('yes', 'true', '1') end) as backward from t)"""


@query("classify_way", _RAW + _DIRECTIONS + f""", k(highway, kind) as (values {_KIND_ROWS}), s(surface, surf) as (values {_SURFACE_ROWS}),
m as (select id, kind, coalesce(surf, 0) as surf, forward, backward,
  (access not in ('no', 'private') or foot in {_words(tags.OPEN)}) and foot not in ('no', 'private') and (kind <> 14 or foot in {_words(tags.OPEN)})
  and (kind <> 5 or foot = '' or foot in {_words(tags.OPEN)}) and not {_listed('sac_scale', tags.FOOT_CLOSED)} as walk,
  (access not in ('no', 'private') or bicycle in {_words(tags.OPEN)}) and bicycle not in ('no', 'private') and (kind <> 14 or bicycle in {_words(tags.OPEN)}) and motorroad <> 'yes'
  and (kind not in (1, 2, 6) or bicycle in {_words([*tags.OPEN, 'dismount'])}) and not {_listed('mtb:scale', tags.BIKE_CLOSED)} as ride,
  {_listed('sac_scale', tags.FOOT_FLAG)} as steep, {_listed('mtb:scale', tags.BIKE_FLAG)} as rough
  from d join k using (highway) left join s on d.surface = s.surface where area <> 'yes')
select id, kind, surf, (case when walk and steep then 1 else 0 end) + (case when ride and rough then 2 else 0 end) as flags,
(case when walk then 1 else 0 end) + (case when ride then 2 else 0 end) as modes, ride and forward as forward, ride and backward as backward from m where walk or ride""")
def classify_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that a mode may use, with their kind, surface, flags, modes and bike directions."""
    return tagged(spark, sf_dir).select("id", tags.classify_way(F.col("tags")).alias("w")).where("w is not null").select("id", "w.*")


@query("bike_direction", _RAW + _DIRECTIONS + " select id, forward, backward from d")
def bike_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward, backward = tags.bike_direction(F.col("tags"))
    return tagged(spark, sf_dir).select("id", forward.alias("forward"), backward.alias("backward"))


_POIS = """, poi as (select id, case when drinking_water <> 'no' and (amenity = 'drinking_water' or drinking_water = 'yes') then 'water' when tourism = 'viewpoint' then 'viewpoint'
when amenity = 'toilets' and access not in ('private', 'no', 'customers') then 'toilets' end as category, seasonal not in ('', 'no') as named from t)"""


@query("classify_poi", _RAW + _POIS + " select id, category, category = 'water' and named as seasonal from poi where category is not null")
def classify_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pois(spark, sf_dir)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("id", tags.classify_poi(F.col("tags")).alias("p")).where("p is not null").select("id", "p.*")


_PLACED = ", placed as (select category, cast(id % 40 as int) as tx, cast(floor(id / 400.0) as int) as ty, id from poi where category is not null)"


@query("poi_per_tile", _RAW + _POIS + _PLACED + " select tx, ty, count(*) as n, count(*) filter (where category = 'water') as water, string_agg(category || ':' || id, ',' order by id, category) as listed from placed group by tx, ty")
def poi_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each tile in their order; tiles are bounded in ground, so a tile's list is too."""
    placed = pois(spark, sf_dir).select("id", "category", (F.col("id") % 40).cast("int").alias("tx"), F.floor(F.col("id") / 400).cast("int").alias("ty"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "category"))), lambda p: F.concat_ws(":", p["category"], p["id"].cast("string"))), ",")
    return placed.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "water").alias("water"), listed.alias("listed"))


@query("way_nodes_mean", """with r as (select distinct l_orderkey as way, cast(l_partkey as int) as node from lineitem), n as (select cast(p_partkey as int) as id, p_partkey % 40 as x, floor(p_partkey / 40.0) as y from part where p_size > 10)
select way, round(avg(x), 4) as x, round(avg(y), 4) as y, count(*) as n from r join n on node = id group by way""")
def way_nodes_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean position of each way's distinct known nodes; ways without one are left out."""
    nodes = read(spark, sf_dir, "part").where("p_size > 10").selectExpr("cast(p_partkey as int) as node", "p_partkey % 40 as x", "floor(p_partkey / 40) as y")
    refs = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as way", "cast(l_partkey as int) as node").distinct()
    return refs.join(nodes, "node").groupBy("way").agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"), F.count("*").alias("n"))


@query("node_modes", _RAW + _DIRECTIONS + """, w as (select id, id % 3 + 1 as modes from d), ends as (select id % 500 as node, modes from w union all select id * 7 % 500, modes from w)
select node, bit_or(modes) as modes from ends group by node""")
def node_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modes that may leave each node: the union over its edges, combined on each task before the shuffle."""
    ways = tagged(spark, sf_dir).select("id", (F.col("id") % 3 + 1).alias("modes"))
    ends = ways.select(F.explode(F.array(F.col("id") % 500, F.col("id") * 7 % 500)).alias("node"), "modes")
    return ends.groupBy("node").agg(F.bit_or("modes").alias("modes"))
