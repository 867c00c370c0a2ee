"""Requests as JSON bodies, read as VARIANT: the criteria of each, or the first field that is not as it must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.functions import geo
from ridgeloom.sources.tiles import _numeric

#: Closed bounds of numbers, words of a surface and of a level, longest lists.
DISTANCE, DURATION, GAIN, PACE, RADIUS = (2.0, 50.0), (15.0, 360.0), (0.0, 2500.0), (3.0, 12.0), (50.0, 1500.0)
SURFACES, LEVELS, WAYPOINTS, AREAS = ("paved", "unpaved", "any"), ("flat", "hilly"), 5, 3
#: Metres of climb that count as a kilometre of effort, least climb a kilometre of a hilly route.
CLIMB_PER_KM, HILLY_PER_KM = 400.0, 10.0


def _at(v: Column, path: str) -> Column:
    """The value at a path: null if it is absent, a JSON null if it is one."""
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _within(v: Column, bounds: tuple[float, float]) -> Column:
    """The number if it is one within closed bounds, else null; a text is no number."""
    n = F.try_variant_get(v, "$", "double")
    return F.when(_numeric(v) & n.between(*bounds), n)


def _word(v: Column, words: tuple[str, ...]) -> Column:
    w = F.try_variant_get(v, "$", "string")
    return F.when(_is(v, "STRING") & w.isin(*words), w)


def _flag(v: Column) -> Column:
    """The value of a JSON boolean, null for anything else."""
    return F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "boolean"))


def _items(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _position(v: Column) -> Column:
    """(lon, lat) of a list of exactly two numbers within bounds, else null."""
    pair = _items(v)
    lon, lat = _within(F.get(pair, F.lit(0)), (-180.0, 180.0)), _within(F.get(pair, F.lit(1)), (-90.0, 90.0))
    return F.when((F.size(pair) == 2) & lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def _area(v: Column) -> Column:
    place, radius = _position(_at(v, "$.center")), _within(_at(v, "$.radius"), RADIUS)
    return F.when(place.isNotNull() & radius.isNotNull(), F.struct(place["lon"].alias("lon"), place["lat"].alias("lat"), radius.alias("radius")))


def _inside(area: Column, p: Column) -> Column:
    x = (p["lon"] - area["lon"]) * F.cos(F.radians(area["lat"])) * geo.PLANE_DEGREE
    return F.hypot(x, (p["lat"] - area["lat"]) * geo.PLANE_DEGREE) <= area["radius"]


def gain_union(level: Column, metres: Column) -> Column:
    """A climb as JSON has it: a word or a number, null for neither."""
    return F.when(level.isNotNull(), F.try_parse_json(F.concat(F.lit('"'), level, F.lit('"')))).otherwise(F.try_parse_json(metres.cast("string")))


def read(rows: DataFrame, body: str = "body", count_gain: bool = True) -> DataFrame:
    """The rows with ``field`` (the first field at fault, null for a request that is in order), ``area`` (the number of the
    avoided area at fault, else 0) and ``criteria``, null beside a fault.

    Fields are looked at in this order: start, target, elevationGain, surface, pace, repeats, includeTechnical, waypoints,
    avoidedAreas, and the target again for the distance that a duration leaves at its pace. A body that is no JSON object
    fails at its start. Unknown fields are ignored. A field that may be left out may not be null. Without ``count_gain`` a
    climb is checked, but dropped. Other columns stay as they are.
    """
    v = F.col("_v")
    parsed = rows.withColumn("_v", F.try_parse_json(body))
    gain, repeats, technical, waypoints, areas = (_at(v, f"$.{n}") for n in ("elevationGain", "repeats", "includeTechnical", "waypoints", "avoidedAreas"))
    target = _at(v, "$.target")
    keys = F.when(_is(target, "OBJECT"), F.map_keys(F.try_variant_get(target, "$", "map<string,variant>")))
    read_fields = {
        "_start": _position(_at(v, "$.start")), "_keys": keys, "_distance": _within(_at(target, "$.distance"), DISTANCE), "_duration": _within(_at(target, "$.duration"), DURATION),
        "_gain": _within(gain, GAIN), "_level": _word(gain, LEVELS), "_surface": _word(_at(v, "$.surface"), SURFACES), "_pace": _within(_at(v, "$.pace"), PACE), "_repeats": _flag(repeats), "_technical": _flag(technical),
        "_waypoints": F.transform(_items(waypoints), _position), "_areas": F.transform(_items(areas), _area),
        **{f"_has_{n}": c.isNotNull() for n, c in (("gain", gain), ("repeats", repeats), ("technical", technical), ("waypoints", waypoints), ("areas", areas))},
    }
    col = F.col
    found = parsed.withColumns(read_fields)
    counted = F.lit(count_gain)
    effort = col("_duration") / col("_pace")
    left = F.when(counted & (col("_level") == "hilly"), effort / (1 + HILLY_PER_KM / CLIMB_PER_KM)).otherwise(effort - F.when(counted, F.coalesce("_gain", F.lit(0.0))).otherwise(0.0) / CLIMB_PER_KM)
    found = found.withColumn("_km", F.coalesce("_distance", left))
    stops = F.concat(F.array("_start"), F.coalesce("_waypoints", F.array().cast("array<struct<lon:double,lat:double>>")))
    wrong = F.transform("_areas", lambda a: a.isNull() | F.exists(stops, lambda p: F.coalesce(_inside(a, p), F.lit(False))))
    at_fault = F.coalesce(F.when(F.size("_areas") <= AREAS, F.array_position(wrong, True)), F.lit(0))
    found = found.withColumn("_area", F.when(col("_has_areas"), at_fault).otherwise(0).cast("int"))
    ok_target = (F.size("_keys") == 1) & F.when(F.array_contains("_keys", "distance"), col("_distance").isNotNull()).otherwise(col("_duration").isNotNull())
    ok_list = lambda has, items, most: ~col(has) | ((F.size(items) <= most) & ~F.exists(items, lambda x: x.isNull()))
    checks = (
        ("start", _is(v, "OBJECT") & col("_start").isNotNull()), ("target", ok_target), ("elevationGain", ~col("_has_gain") | col("_gain").isNotNull() | col("_level").isNotNull()),
        ("surface", col("_surface").isNotNull()), ("pace", col("_pace").isNotNull()), ("repeats", ~col("_has_repeats") | col("_repeats").isNotNull()), ("includeTechnical", ~col("_has_technical") | col("_technical").isNotNull()),
        ("waypoints", ok_list("_has_waypoints", "_waypoints", WAYPOINTS)), ("avoidedAreas", ok_list("_has_areas", "_areas", AREAS) & (col("_area") == 0)), ("target", col("_km").between(*DISTANCE)),
    )
    field = F.coalesce(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks])
    keep = lambda c: F.when(counted, col(c))
    criteria = F.struct(
        col("_start").alias("start"), col("_distance").alias("distance"), col("_duration").alias("duration"), keep("_gain").alias("gain"), keep("_level").alias("level"), col("_surface").alias("surface"), col("_pace").alias("pace"),
        F.coalesce("_repeats", F.lit(False)).alias("repeats"), F.coalesce("_technical", F.lit(False)).alias("technical"), F.coalesce("_waypoints", F.array().cast("array<struct<lon:double,lat:double>>")).alias("waypoints"),
        F.coalesce("_areas", F.array().cast("array<struct<lon:double,lat:double,radius:double>>")).alias("areas"), col("_km").alias("km"),
    )
    out = found.withColumn("field", field).withColumn("area", F.when(col("field") == "avoidedAreas", col("_area")).otherwise(0)).withColumn("criteria", F.when(col("field").isNull(), criteria))
    return out.select(*rows.columns, "field", "area", "criteria")
