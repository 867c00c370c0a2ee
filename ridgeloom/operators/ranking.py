"""Ranking of candidate routes: checks against a request, scores, kinds, and the pick of different routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest gaps of the tiers (share of the distance; share and floor of the climb in metres).
DISTANCE, GAIN = (0.10, 0.25, 0.35), ((0.2, 50.0), (0.5, 100.0), (0.75, 150.0))
#: Scale of the climb's gap at least, its weight, metres of climb a kilometre of effort, share of cells in common.
GAIN_SCALE, GAIN_WEIGHT, CLIMB_PER_KM, SHARED = 250.0, 3.0, 400.0, 0.5
#: Climb a kilometre of flat (at most) and hilly (at least) routes: match, suggestion.
FLAT, HILLY = (10.0, 20.0), (10.0, 5.0)
MATCH, SUGGESTION, WIDE, OUT = range(4)


def _tier(gap: Column, bounds: list[Column]) -> Column:
    tier = F.lit(OUT)
    for k in reversed(range(len(bounds))):
        tier = F.when(F.abs(gap) <= bounds[k], k).otherwise(tier)
    return tier


def distance_check(length: Column, target: Column) -> tuple[Column, Column]:
    """Tier and relative gap of a length or a duration."""
    return _tier(length - target, [target * share for share in DISTANCE]), F.abs(length - target) / target


def gain_check(gain: Column, target: Column) -> tuple[Column, Column]:
    """The same of a climb in metres, its gap with its weight; small targets share one scale. The weight comes first, as in
    SQL: the other order rounds otherwise, and scores that are equal but for that would be ranked apart from it."""
    return _tier(gain - target, [F.greatest(target * share, F.lit(floor)) for share, floor in GAIN]), GAIN_WEIGHT * F.abs(gain - target) / F.greatest(target, F.lit(GAIN_SCALE))


def level_check(km: Column, gain: Column, hilly: bool) -> tuple[Column, Column]:
    """The same of a kind of terrain, which has no wide tier: at most so much climb a kilometre, or at least."""
    match, suggestion = HILLY if hilly else FLAT
    rate, gap = gain / km, gain - match * km
    within = (lambda bound: rate >= bound) if hilly else (lambda bound: rate <= bound)
    return F.when(within(match), MATCH).when(within(suggestion), SUGGESTION).otherwise(OUT), F.greatest(F.lit(0.0), -gap if hilly else gap) / (match * km)


def surface_mismatch(surface: Column, unpaved: Column) -> Column:
    return F.when(surface == "unpaved", 1 - unpaved).when(surface == "paved", unpaved).otherwise(0.0)


def target_km(distance: Column, minutes: Column, pace: Column, gain: Column, hilly: Column) -> Column:
    """The distance to look for; null where a duration leaves less than 2 km."""
    effort = minutes / pace
    found = F.when(hilly, effort / (1 + HILLY[0] / CLIMB_PER_KM)).otherwise(effort - F.coalesce(gain, F.lit(0.0)) / CLIMB_PER_KM)
    return F.coalesce(distance, F.when(found >= 2, found))


def classified(candidates: DataFrame) -> DataFrame:
    """Candidates with score, tier and kind; those out of reach are dropped.

    Columns: km, gain, target_km, target_gain, surface, unpaved, retrace, direct, and where they are asked for minutes
    (the duration wanted, if no distance is), pace and effort_km (the distance with its slopes), level ('flat' or 'hilly'
    instead of a gain in metres) and lollipop. A route is checked on its distance, or else its duration; and on its climb,
    unless the route or the request has none. A climb that misses a target in metres is kept as wide, a level is not. A
    direct loop beyond what it is first checked on is offered whatever else it misses. Its way back is no flaw, nor is a
    lollipop's stem. Null marks count as false, a null share as 0.
    """
    has = set(candidates.columns)
    col = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    flag = lambda name: F.coalesce(col(name, "boolean"), F.lit(False))
    km, gain, level = F.col("km"), F.col("gain"), col("level", "string")
    by_distance = F.coalesce(F.col("target_km") > 0, F.lit(False))
    length = F.when(by_distance, km).otherwise(col("effort_km", "double") * col("pace", "double"))
    target = F.when(by_distance, F.col("target_km")).otherwise(col("minutes", "double"))
    far, far_gap = distance_check(length, target)
    (high, high_gap), flat, hilly = gain_check(gain, F.col("target_gain")), level_check(km, gain, False), level_check(km, gain, True)
    beyond = flag("direct") & (length - target > DISTANCE[-1] * target)
    climbs = gain.isNotNull() & (level.isNotNull() | F.col("target_gain").isNotNull())
    by_level = [F.when(level == "flat", a).otherwise(b) for a, b in zip(flat, hilly, strict=True)]
    tier = F.when(~climbs, MATCH).when(level.isNotNull(), by_level[0]).otherwise(F.least(high, F.lit(WIDE)))
    more = F.when(~climbs, 0.0).when(level.isNotNull(), by_level[1]).otherwise(high_gap)
    worst = F.greatest(*[F.when((t == OUT) & beyond, WIDE).otherwise(t) for t in (far, tier)])
    shape = F.when(flag("direct") | flag("lollipop"), 0.0).otherwise(F.coalesce("retrace", F.lit(0.0)))
    score = far_gap + more + F.coalesce(surface_mismatch(F.col("surface"), F.col("unpaved")), F.lit(0.0)) + shape
    rows = candidates.withColumns({"score": score, "tier": worst}).where(F.col("tier") < OUT)
    return rows.withColumn("kind", F.when(F.col("tier") == MATCH, "match").otherwise("suggestion"))


def closest_gain(routes: DataFrame, key: str, order: str) -> DataFrame:
    """(key, gain): the climb nearest to the request's target of routes (key, gain, target_gain), the first in ``order`` on
    ties; null where one of them is a match for it, or none has a climb."""
    gap = F.abs(F.col("gain") - F.col("target_gain"))
    met = F.max(F.coalesce(gap <= F.greatest(F.col("target_gain") * GAIN[0][0], F.lit(GAIN[0][1])), F.lit(False)))
    best = F.min(F.when(gap.isNotNull(), F.struct(gap.alias("gap"), F.col(order), F.col("gain").alias("gain"))))
    return routes.groupBy(key).agg(met.alias("met"), best.alias("best")).select(key, F.when(~F.col("met"), F.col("best.gain")).alias("gain"))


def best_laps(loops: DataFrame, most: int = 10, longest_km: float = 50.0) -> DataFrame:
    """(loop, laps): how often to run a direct loop (loop, km, gain and the columns of ``classified``), by tier, score, laps."""
    laps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(most), F.floor(longest_km / F.col("km")).cast("int"))))
    each = loops.withColumn("laps", F.explode(laps)).withColumns({"km": F.col("km") * F.col("laps"), "gain": F.col("gain") * F.col("laps"), "direct": F.lit(True)})
    return classified(each).groupBy("loop").agg(F.min(F.struct("tier", "score", "laps"))["laps"].alias("laps"))


def picked(ranked: DataFrame, limit: int = 8, fill: int = 3) -> DataFrame:
    """(request, id, place) of the routes offered, of ranked candidates (request, id, score, tier, direct, cells).

    In order of score and id, matches up to ``limit``, then suggestions and wide ones up to ``fill``, none that shares over
    half of its cells with one picked before (of the smaller set; of the larger beside a direct loop). A direct loop
    that is no duplicate takes the last place. The choice depends on all before it, so it is a fold over the candidates
    of a request, whose number the search bounds.
    """
    entry = F.struct("score", "id", "tier", "direct", "cells")
    lists = ranked.groupBy("request").agg(F.array_sort(F.collect_list(entry)).alias("every"))

    def shares(chosen: Column, e: Column) -> Column:
        def too_much(p: Column) -> Column:
            shared, a, b = F.size(F.array_intersect(p["cells"], e["cells"])), F.size(p["cells"]), F.size(e["cells"])
            of = F.when(p["direct"] | e["direct"], F.greatest(a, b)).otherwise(F.least(a, b))
            return F.when(of > 0, shared / of > SHARED).otherwise(False)

        return F.exists(chosen, too_much)

    def taking(tier: int, size: int):
        return lambda chosen, e: F.when((e["tier"] == tier) & (F.size(chosen) < size) & ~shares(chosen, e), F.concat(chosen, F.array(e))).otherwise(chosen)

    rows = lists.withColumn("chosen", F.slice("every", 1, 0))
    for tier, size in ((MATCH, limit), (SUGGESTION, fill), (WIDE, fill)):
        rows = rows.withColumn("chosen", F.aggregate("every", F.col("chosen"), taking(tier, size)))
    direct = F.get(F.filter("every", lambda e: e["direct"]), F.lit(0))
    rows = rows.withColumn("loop", direct)
    missing = F.col("loop").isNotNull() & ~F.exists("chosen", lambda p: p["direct"]) & ~shares(F.col("chosen"), F.col("loop"))
    rows = rows.withColumn("chosen", F.when(missing, F.concat(F.slice("chosen", 1, limit - 1), F.array("loop"))).otherwise(F.col("chosen")))
    ordered = F.array_sort(F.transform("chosen", lambda p: F.struct(p["tier"].alias("tier"), p["score"].alias("score"), p["id"].alias("id"))))
    return rows.select("request", F.posexplode(ordered).alias("place", "p")).select("request", "p.id", (F.col("place") + 1).alias("place"))


def avoided(edges: DataFrame, used: DataFrame, factor: float = 6.0) -> DataFrame:
    """Edges (pair, cost) with the cost of those on used pairs multiplied."""
    marks = used.select("pair").distinct().withColumn("used", F.lit(True))
    return edges.join(marks, "pair", "left").withColumn("cost", F.col("cost") * F.when(F.col("used"), factor).otherwise(1.0)).drop("used")
