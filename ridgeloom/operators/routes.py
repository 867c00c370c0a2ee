"""Route analytics: joins of way references, folds and windows along a route, ranking tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeloom.functions import geo


def refs_nodes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (way, pos, node) with their node's columns, null where it is missing, and whether each is its
    node's first reference in (way, pos) order. The first is a minimum by node, so a hot node costs no sort."""
    first = refs.groupBy("node").agg(F.min(F.struct("way", "pos")).alias("at"))
    marked = refs.join(first, "node").select(refs["*"], (F.struct("way", "pos") == F.col("at")).alias("first_ref"))
    return marked.join(nodes, marked.node == nodes.id, "left").drop("id")


def steps(refs: DataFrame, *keep: str) -> DataFrame:
    """Neighbouring references of each way as steps (way, pos, a, b); steps from a node to itself are dropped."""
    after = Window.partitionBy("way").orderBy("pos")
    return refs.select("way", "pos", F.col("node").alias("a"), F.lead("node").over(after).alias("b"), *keep).where("b is not null and a <> b")


def degree(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and how many ends of edges it has; ends are counted on each task before the shuffle."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def climb(heights: Column, band: float = 2.0) -> Column:
    """Ascent over an array of heights; a change counts once it reaches ``band`` from the last counted height."""
    start = F.struct(F.lit(0.0).alias("up"), F.get(heights, F.lit(0)).cast("double").alias("ref"))

    def step(acc: Column, z: Column) -> Column:
        moved = F.abs(z - acc["ref"]) >= band
        return F.struct((acc["up"] + F.when(moved, F.greatest(z - acc["ref"], F.lit(0.0))).otherwise(0.0)).alias("up"), F.when(moved, z).otherwise(acc["ref"]).cast("double").alias("ref"))

    return F.aggregate(heights, start, step, lambda acc: acc["up"])


def ordered(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """The values of each route in order, as one array: a fold over a route needs all of it."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda s: s["_v"]).alias(name))


def running_distance(points: DataFrame) -> DataFrame:
    """Points (route, pos, lat, lon) with the metres walked so far."""
    along = Window.partitionBy("route").orderBy("pos")
    seg = geo.haversine(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon"))
    return points.withColumn("seg", F.coalesce(seg, F.lit(0.0))).withColumn("metres", F.sum("seg").over(along))


def stretches(rows: DataFrame, key: str, pos: str, *what: str) -> DataFrame:
    """Runs of neighbouring rows that agree in ``what``: key, run, from_pos, to_pos, rows and the values."""
    along = Window.partitionBy(key).orderBy(pos)
    same = F.lit(True)
    for c in what:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(along))
    turned = F.when((F.row_number().over(along) > 1) & same, 0).otherwise(1)
    runs = rows.withColumn("_t", turned).withColumn("run", F.sum("_t").over(along).cast("int"))
    return runs.groupBy(key, "run", *what).agg(F.min(pos).alias("from_pos"), F.max(pos).alias("to_pos"), F.count("*").alias("n"))


def repeated_metres(rows: DataFrame, key: str, pos: str, pair: str, length: str) -> DataFrame:
    """Metres of each route in all, and on edges walked before."""
    again = F.row_number().over(Window.partitionBy(key, pair).orderBy(pos)) > 1
    return rows.withColumn("_again", again).groupBy(key).agg(F.sum(length).alias("metres"), F.sum(F.when(F.col("_again"), F.col(length)).otherwise(0.0)).alias("repeated"))


def distance_tier(relative_gap: Column) -> Column:
    """match, suggestion, wide or none for a relative distance gap."""
    return F.when(relative_gap <= 0.10, "match").when(relative_gap <= 0.25, "suggestion").when(relative_gap <= 0.35, "wide").otherwise("none")


def gain_tier(gap: Column, target: Column) -> Column:
    """The same for a climb gap, with floors of 50, 100 and 150 m."""
    tier = F.lit("none")
    for share, floor, name in ((0.75, 150, "wide"), (0.5, 100, "suggestion"), (0.2, 50, "match")):
        tier = F.when(gap <= F.greatest(target * share, F.lit(float(floor))), name).otherwise(tier)
    return tier


def highest_by_sector(nodes: DataFrame, lat: float, lon: float, reach: float) -> DataFrame:
    """The highest node of each of 12 sectors in 2 rings around a point; lower id on ties."""
    x = (F.col("lat") * 0 + F.col("lon") - lon) * F.cos(F.radians(F.lit(lat))) * geo.PLANE_DEGREE
    y = (F.col("lat") - lat) * geo.PLANE_DEGREE
    placed = nodes.select("id", "elev", x.alias("x"), y.alias("y")).withColumn("d", F.hypot("x", "y")).where(F.col("d") <= reach)
    sector = F.pmod(F.floor((F.atan2("y", "x") + 3.141592653589793) / (2 * 3.141592653589793) * 12), F.lit(12))
    ring = F.when(F.col("d") < reach / 2, 0).otherwise(1)
    return placed.groupBy(ring.alias("ring"), sector.cast("int").alias("sector")).agg(F.max_by("id", F.struct("elev", -F.col("id"))).alias("id"), F.max("elev").alias("elev"))


def crow_flies(points: DataFrame) -> DataFrame:
    """(route, metres) of straight lines from each route's first point through the others (route, pos, lat, lon) and back."""
    along = Window.partitionBy("route").orderBy("pos")
    x, y = geo.metres_from(F.first("lat").over(along), F.first("lon").over(along), F.col("lat"), F.col("lon"))
    placed = points.select("route", "pos", x.alias("x"), y.alias("y"))
    step = F.hypot(F.col("x") - F.coalesce(F.lag("x").over(along), F.lit(0.0)), F.col("y") - F.coalesce(F.lag("y").over(along), F.lit(0.0)))
    home = F.when(F.lead("pos").over(along).isNull(), F.hypot("x", "y")).otherwise(0.0)
    return placed.select("route", (step + home).alias("m")).groupBy("route").agg(F.sum("m").alias("metres"))


def along(points: DataFrame, scale: float = 1.0) -> DataFrame:
    """Points (route, pos, lat, lon and more) with the metres in the plane before them (from_m), to the next point (to_m)
    and the next point's columns as n_lat, n_lon and so on; the last point of a route has none."""
    order = Window.partitionBy("route").orderBy("pos")
    seg = geo.planar(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    rows = points.withColumn("_s", F.coalesce(seg, F.lit(0.0)) * scale).withColumn("from_m", F.sum("_s").over(order)).drop("_s")
    following = {f"n_{c}": F.lead(c).over(order) for c in points.columns if c not in ("route", "pos")}
    return rows.withColumns({**following, "to_m": F.lead("from_m").over(order)})


def between(rows: DataFrame, value: str, metres: Column) -> Column:
    """A value of ``along`` rows at so many metres, on the line to the next point."""
    share = F.when(F.col("to_m") > F.col("from_m"), (metres - F.col("from_m")) / (F.col("to_m") - F.col("from_m"))).otherwise(0.0)
    return F.col(value) + share * (F.col(f"n_{value}") - F.col(value))


def every(rows: DataFrame, step: float, first: int, short: float) -> DataFrame:
    """``along`` rows, once for each k >= first with k * step within their segment (metres), short of the route's end by ``short``.

    A segment holds what lies beyond its start, up to its end; the first one of a route holds its start too. So samples
    are dealt out segment by segment, without a join of distances.
    """
    whole = Window.partitionBy("route")
    ends = rows.withColumn("total", F.max("from_m").over(whole)).withColumn("_first", F.min("pos").over(whole))
    low = F.when(F.col("pos") == F.col("_first"), first).otherwise(F.greatest(F.lit(first), F.floor(F.col("from_m") / step) + 1))
    high = F.floor(F.col("to_m") / step)
    within = F.when(F.col("to_m").isNotNull() & (low <= high), F.sequence(low.cast("long"), high.cast("long")))
    found = ends.withColumn("k", F.explode(within)).drop("_first").withColumn("metres", F.col("k") * step)
    return found.where(F.col("metres") < F.col("total") - short)


def effort_factor(points: DataFrame, stretch: float = 50.0) -> DataFrame:
    """(route, factor): effort by slope over stretches of at least ``stretch`` metres against the flat, of points (route, pos, lat, lon, z).

    A stretch ends at the point that completes it, so the cut depends on all before it: a fold over each route's
    segments in order. A route of one point or no length is flat.
    """
    rows = along(points).where("to_m is not null")
    steps = F.array_sort(F.collect_list(F.struct("pos", (F.col("to_m") - F.col("from_m")).alias("m"), F.col("n_z").alias("z"), F.col("z").alias("z0"))))
    lists = rows.groupBy("route").agg(steps.alias("s")).withColumn("n", F.size("s"))
    start = F.struct(F.lit(0.0).alias("far"), F.get("s", F.lit(0))["z0"].cast("double").alias("low"), F.lit(0.0).alias("total"), F.lit(0.0).alias("effort"), F.lit(0).alias("k"))

    def step(acc: Column, q: Column) -> Column:
        far = acc["far"] + q["m"]
        going = (far < stretch) & (acc["k"] + 1 < F.col("n"))
        done = F.when(far > 0, far * geo.slope_weight((q["z"] - acc["low"]) / far)).otherwise(0.0)
        return F.struct(
            F.when(going, far).otherwise(0.0).alias("far"), F.when(going, acc["low"]).otherwise(q["z"]).cast("double").alias("low"),
            (acc["total"] + q["m"]).alias("total"), (acc["effort"] + F.when(going, 0.0).otherwise(done)).alias("effort"), (acc["k"] + 1).alias("k"),
        )

    factor = F.aggregate("s", start, step, lambda acc: F.when(acc["total"] > 0, acc["effort"] / acc["total"]).otherwise(1.0))
    single = points.select("route").distinct().join(lists.select("route", factor.alias("factor")), "route", "left")
    return single.select("route", F.coalesce("factor", F.lit(1.0)).alias("factor"))


def cell_visits(points: DataFrame, keep_out: float, cell: float = 25.0, sample: float = 5.0) -> DataFrame:
    """(route, i, cx, cy, along): cells that routes (route, pos, lat, lon) pass in order, sampled each few metres, beyond
    ``keep_out`` metres from the start; neighbouring visits of one cell are one."""
    order = Window.partitionBy("route").orderBy("pos")
    x, y = geo.metres_from(F.first("lat").over(order), F.first("lon").over(order), F.col("lat"), F.col("lon"))
    rows = points.select("route", "pos", x.alias("x"), y.alias("y")).withColumn("nx", F.lead("x").over(order)).withColumn("ny", F.lead("y").over(order))
    rows = rows.withColumn("len", F.coalesce(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")), F.lit(0.0)))
    rows = rows.withColumn("from_m", F.sum("len").over(order) - F.col("len")).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("len") / sample)))
    each = rows.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("f", F.col("s") / F.col("n"))
    at = lambda c: F.round(F.col(c) + F.coalesce(F.col(f"n{c}") - F.col(c), F.lit(0.0)) * F.col("f"), 6)
    placed = each.select("route", "pos", "s", at("x").alias("x"), at("y").alias("y"), (F.col("from_m") + F.col("len") * F.col("f")).alias("along"))
    cells = placed.where(F.hypot("x", "y") > keep_out).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    walk = Window.partitionBy("route").orderBy("pos", "s")
    new = cells.withColumn("same", F.struct("cx", "cy").eqNullSafe(F.lag(F.struct("cx", "cy")).over(walk))).where("not same")
    return new.select("route", F.row_number().over(walk).alias("i"), "cx", "cy", "along")


def retrace_share(visits: DataFrame, loop: float = 100.0) -> DataFrame:
    """(route, share) of ``cell_visits`` that come back to a cell after ``loop`` metres or more, or are come back to."""
    same = Window.partitionBy("route", "cx", "cy").orderBy("i")
    back = F.coalesce(F.col("along") - F.lag("along").over(same) >= loop, F.lit(False)) | F.coalesce(F.lead("along").over(same) - F.col("along") >= loop, F.lit(False))
    return visits.withColumn("back", back).groupBy("route").agg((F.count_if("back") / F.count("*")).alias("share"))


def shared_shares(cells: DataFrame) -> DataFrame:
    """(a, b, shared, of_small, of_large) of routes that share a cell, a before b, of distinct cells (route, cx, cy).

    Only routes that meet in a cell are compared. A cell of very many routes makes as many pairs as they have, which is
    the result's own size.
    """
    distinct = cells.select("route", "cx", "cy").distinct()
    sizes = distinct.groupBy("route").agg(F.count("*").alias("n"))
    a, b = distinct.withColumnRenamed("route", "a"), distinct.withColumnRenamed("route", "b")
    shared = a.join(b, ["cx", "cy"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("route").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("route").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "shared", (F.col("shared") / F.least("na", "nb")).alias("of_small"), (F.col("shared") / F.greatest("na", "nb")).alias("of_large"))


def rescaled(rows: DataFrame, key: str, order: str, counted: str, total: Column) -> Column:
    """Totals at each stop, scaled so that the last is ``total``; where nothing was counted, only the last is it."""
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last, at_end = F.last(counted).over(whole), F.lead(order).over(Window.partitionBy(key).orderBy(order)).isNull()
    return F.when(last == 0, F.when(at_end, total).otherwise(F.col(counted))).otherwise(F.col(counted) * total / last)
