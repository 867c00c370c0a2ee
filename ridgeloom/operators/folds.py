"""Folds along routes of any length, by blocks: what a block does to the state before it is worked out without that state.

A climb counts once the height is ``band`` or more from the last counted one, so the state is one height. A block's first
heights decide what becomes of it: as long as the state lies within the band of all of them it stays, and at the first
height that it does not it becomes that height, from where on the block goes on alike for all states. So a block is a
short table: for each height that lies beyond the reach of those before it, the range of states that stop there, and what
the rest of the block adds. Its rows are as many as new highest or lowest heights before the block spans two bands (some
40 for heights in decimetres), whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeloom.scratch import drop, written

#: Fixed value: metres of height that count.
BAND = 2.0


def _counted(z: np.ndarray, first: int, band: float) -> tuple[list[int], float]:
    """(places at which the state changes after ``first``, where it is z[first]), and the state at the end."""
    at, ref = [], z[first]
    k = first + 1
    while k < len(z):  # to the next height out of the band, in growing steps
        step = 64
        while k < len(z):
            hit = np.flatnonzero(np.abs(z[k : k + step] - ref) >= band)
            if len(hit):
                k += int(hit[0])
                break
            k += step
            step *= 4
        if k < len(z):
            at.append(k)
            ref = z[k]
            k += 1
    return at, float(ref)


def pieces(z: np.ndarray, band: float) -> list[tuple[float, float, int]]:
    """(low, high, place): states in [low, high] turn at the place. A height stops the states above it by the band or more
    and those below it likewise, unless an earlier one did."""
    out, low, high = [], -np.inf, np.inf  # states in (low, high) have not turned yet
    for k in range(len(z)):
        up, down = z[k] - band, z[k] + band
        if up > low:
            out.append((low, min(up, high), k))
            low = up
        if down < high and low < high:
            out.append((max(down, low), high, k))
            high = down
        if low >= high:
            break
    return out


def climbs(points: DataFrame, band: float = BAND) -> DataFrame:
    """(route, pos, up, down): the climb and descent counted from the start of each route (route, pos, z) to each point.

    Points are dealt out by ranges of (route, pos) and written. Each range's part of a route becomes a table of what it does
    to the state; these, some rows for each range, are put together along the route; then each part counts on from
    its own state. So no task holds a route, though one may have most of the points. Rows with a null are no points.
    """
    kinds = dict(points.dtypes)
    clean = points.select("route", "pos", F.col("z").cast("double").alias("z")).dropna()
    rows = written(clean, "heights")
    dealt = written(rows.repartitionByRange("route", "pos").withColumn("part", F.spark_partition_id()), "dealt")
    drop(rows)

    def table(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        z = part.column("z").to_numpy()
        found = pieces(z, band)
        low, high, at = (list(c) for c in zip(*found, strict=True))
        ups, downs, ends = [], [], []
        for k in at:
            turns, end = _counted(z, k, band)
            steps = np.diff(z[[k, *turns]])
            ups.append(float(steps[steps > 0].sum()))
            downs.append(float(-steps[steps < 0].sum()))
            ends.append(end)
        n = len(at)
        first = [part.column(c).slice(0, 1).combine_chunks() for c in ("route", "part")]
        same = [pa.concat_arrays([c] * n) for c in first]
        return pa.table([*same, pa.array(low), pa.array(high), pa.array(z[at]), pa.array(ups), pa.array(downs), pa.array(ends), pa.array([float(z[0])] * n), pa.array(at, pa.int32())], ["route", "part", "low", "high", "z", "up", "down", "end", "first", "at"])

    tables = dealt.groupBy("route", "part").applyInArrow(table, f"route {kinds['route']}, part int, low double, high double, z double, up double, down double, end double, first double, at int")
    lists = tables.groupBy("route", "part").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high", "z", "up", "down", "end"))).alias("t"), F.first("first").alias("first"))
    parts = written(lists, "parts")
    every = parts.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("part", "first", "t"))).alias("parts"))  # some rows for each range
    state = lambda part, ref, up, down: F.struct(part.alias("part"), ref.alias("ref"), up.alias("up"), down.alias("down"))

    def onward(states, p):
        before = F.element_at(states, -1)
        ref = before["ref"]
        hit = F.get(F.filter(p["t"], lambda x: (ref >= x["low"]) & (ref <= x["high"])), F.lit(0))
        turned = hit.isNotNull()
        gone = hit["z"] - ref
        return F.concat(F.slice(states, 1, F.size(states) - 1), F.array(state(p["part"], before["ref"], before["up"], before["down"]), state(
            F.lit(-1), F.when(turned, hit["end"]).otherwise(ref), before["up"] + F.when(turned, hit["up"] + F.greatest(gone, F.lit(0.0))).otherwise(0.0), before["down"] + F.when(turned, hit["down"] + F.greatest(-gone, F.lit(0.0))).otherwise(0.0))))

    zero = F.lit(0.0)
    start = F.array(state(F.lit(-1), F.get("parts", F.lit(0))["first"], zero, zero))
    states = every.select("route", F.explode(F.aggregate("parts", start, onward)).alias("s")).where("s.part >= 0").select("route", "s.part", "s.ref", "s.up", "s.down")
    given = dealt.join(states.withColumnsRenamed({"up": "up0", "down": "down0"}), ["route", "part"])

    def count(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        z = np.concatenate([[part.column("ref")[0].as_py()], part.column("z").to_numpy()])
        turns, _ = _counted(z, 0, band)
        steps = np.zeros(len(z))
        steps[turns] = np.diff(z[[0, *turns]])
        up, down = np.cumsum(np.maximum(steps, 0))[1:], np.cumsum(np.maximum(-steps, 0))[1:]
        return pa.table([part.column("route"), part.column("pos"), pa.array(up + part.column("up0")[0].as_py()), pa.array(down + part.column("down0")[0].as_py())], ["route", "pos", "up", "down"])

    out = written(given.groupBy("route", "part").applyInArrow(count, f"route {kinds['route']}, pos {kinds['pos']}, up double, down double"), "climbs")
    drop(dealt, parts)
    return out


def totals(points: DataFrame, band: float = BAND) -> DataFrame:
    """(route, up, down): the climb of each route (route, pos, z), and its descent, which is the climb of the way back."""
    back = points.select("route", (-F.col("pos")).alias("pos"), "z")
    top = lambda rows, name: climbs(rows, band).groupBy("route").agg(F.max_by("up", "pos").alias(name))
    return top(points, "up").join(top(back, "down"), "route")
