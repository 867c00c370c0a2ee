"""From the rows of a map extract (kind, id, lat, lon, tags, refs) to the edges of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.operators.graph import running_sums


def walkable(rows: DataFrame, classify: Callable[[Column], Column]) -> DataFrame:
    """(way, pos, node and the classes) of the references of ways that some mode may use and that have two or more; a way
    that is null, untagged or shorter has none. Of rows that repeat a way's id each is a way of its own, numbered apart."""
    known = rows.where("kind = 'way' and size(refs) > 1").select(F.col("id").alias("way"), classify(F.coalesce("tags", F.create_map().cast("map<string,string>"))).alias("c"), "refs")
    return known.where("c is not null").select("way", "c.*", F.posexplode("refs").alias("pos", "node")).withColumn("pos", F.col("pos") + 1)


def node_places(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, lat, lon and further columns of nodes) of the nodes that references name; of rows that repeat an id, the least."""
    kept = [c for c in rows.columns if c not in ("kind", "id", "tags", "refs")]
    own = rows.where("kind = 'node'").select(F.col("id").alias("node"), F.struct(*kept).alias("at"))
    named = own.join(refs.select("node").distinct(), "node", "left_semi")
    return named.groupBy("node").agg(F.min("at").alias("at")).select("node", "at.*")


def steps_between_known(refs: DataFrame, rows: DataFrame, *keep: str) -> DataFrame:
    """(way, pos, a, b, positions as lat1, lon1, lat2, lon2, the columns ``keep``) of neighbouring references.

    A reference to a node that the extract lacks, or whose height (z, where nodes have one) is unknown, breaks the way: no
    step leads over it. A step from a node to itself is none.
    """
    places = node_places(refs, rows)
    if "z" in places.columns:
        places = places.where("z is not null and not isnan(z)")
    met = refs.join(places, "node")
    end = met.select("way", (F.col("pos") - 1).alias("pos"), F.col("node").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    start = met.select("way", "pos", F.col("node").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *keep)
    return start.join(end, ["way", "pos"]).where("a <> b")


def placed(steps: DataFrame) -> DataFrame:
    """The steps with the places of their ends (a, b) among all nodes that have an edge, in the order of ids, and the ids as
    a_id and b_id; nodes without an edge get no place."""
    ends = steps.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("one", F.lit(1).cast("long"))
    ranks = running_sums(ends, ["node"], "one", "place").select("node", "place")
    named = steps.withColumnsRenamed({"a": "a_id", "b": "b_id"})
    left = named.join(ranks.select(F.col("node").alias("a_id"), F.col("place").alias("a")), "a_id")
    return left.join(ranks.select(F.col("node").alias("b_id"), F.col("place").alias("b")), "b_id")
