"""Graph operators as rounds of joins and partial minima; each round is written in the shared folder."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeloom.scratch import drop, written


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder of the cluster."""
    return written(df, "cut")


def labels(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of undirected edges (a, b), by star contraction; the component is its smallest node.

    Each larger neighbour of a node points to the node's smallest, then each smaller one does. Rounds grow with the
    logarithm of the longest path; each is a few joins and partial minima on the edges alone. Nothing but an edge count
    and a checksum reaches the driver.
    """
    now, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if not mark[0] or mark == before:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.where("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        moved = large.where("u <> v").join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now, old = cut(small.where("u <> v").distinct()), now
        drop(old)
    tops = now.select(F.col("v").alias("node")).distinct()
    return now.selectExpr("u node", "v component").union(tops.selectExpr("node", "node component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every node of undirected edges (a, b)."""
    placed = labels(edges)
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    return placed.join(sizes, "component").select("node", "component", "size")


def landmarks(nodes: DataFrame, count: int = 8, share: float = 0.95) -> DataFrame:
    """(mark, node): the node (id, lat, lon) nearest to each of ``count`` places on an ellipse inside the nodes' box, lower id on ties.

    The box is one row and the places are ``count``, so they are sent to every task; each place is a partial minimum.
    """
    box = nodes.agg(*[F.expr(e) for e in ("(min(lat) + max(lat)) / 2 as lat0", "(max(lat) - min(lat)) / 2 as tall", "(min(lon) + max(lon)) / 2 as lon0", "(max(lon) - min(lon)) / 2 as wide")])
    places = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("mark"))
    turn = 2 * math.pi * F.col("mark") / count
    aims = places.select("mark", (F.col("lat0") + share * F.col("tall") * F.sin(turn)).alias("mlat"), (F.col("lon0") + share * F.col("wide") * F.cos(turn)).alias("mlon"))
    x = (F.col("lon") - F.col("mlon")) * F.cos(F.radians("mlat"))
    gap = F.round(F.pow(x, 2) + F.pow(F.col("lat") - F.col("mlat"), 2), 15)
    return nodes.join(F.broadcast(aims)).groupBy("mark").agg(F.min(F.struct(gap.alias("gap"), "id"))["id"].alias("node"))


def middle(nodes: DataFrame) -> DataFrame:
    """(id) of the node (id, lat, lon) nearest to the middle of all nodes' box, lower id on ties."""
    box = nodes.agg(((F.min("lat") + F.max("lat")) / 2).alias("mlat"), ((F.min("lon") + F.max("lon")) / 2).alias("mlon"))
    gap = F.pow((F.col("lon") - F.col("mlon")) * F.cos(F.radians("mlat")), 2) + F.pow(F.col("lat") - F.col("mlat"), 2)
    return nodes.join(F.broadcast(box)).agg(F.min(F.struct(F.round(gap, 15).alias("gap"), "id"))["id"].alias("id")).where("id is not null")


def reachable_landmarks(nodes: DataFrame, reached: DataFrame, count: int = 8, share: float = 0.95) -> DataFrame:
    """``landmarks`` among the nodes that costs (node) reach, so that none sits on an island; nodes that share a place count once."""
    return landmarks(nodes.join(reached.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), count, share)


def landmark_bound(a, b, unit: int = 16):
    """A lower bound on the cost between two nodes, of their costs to the landmarks in units (65535: unreachable)."""
    far = F.zip_with(a, b, lambda x, y: F.when((x != 65_535) & (y != 65_535), F.abs(x - y) - 1).otherwise(0))
    return F.greatest(F.lit(0), F.array_max(far)) * unit


def running_sums(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The rows with the sum of ``value`` over all rows before them in the order of columns that tell rows apart.

    Rows are dealt out by ranges and written; sums of whole ranges, one row each, are added to those within a range, so
    that no task sorts the table.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(dealt)
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_within", within).join(F.broadcast(before.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")
