"""Classes of tagged map objects, as column expressions over a map of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeloom.functions.ways import KINDS, SURFACES

#: Highway tag values and their kinds.
HIGHWAYS = {k: k for k in KINDS} | {f"{k}_link": k for k in ("tertiary", "secondary", "primary", "trunk")}
#: Surface tag values of each group; any other value is unknown.
SURFACE_VALUES = {
    "paved": "asphalt paved concrete concrete:plates concrete:lanes brick bricks cement chipseal paving_stones metal wood sett",
    "compact": "compacted fine_gravel gravel unpaved",
    "rough": "dirt earth ground grass sand mud rock pebblestone cobblestone unhewn_cobblestone stepping_stones grass_paver woodchips",
}
#: Access words, and the scale values that flag or close a way.
OPEN, CLOSED, TRUE, BACKWARD = ("yes", "designated", "permissive"), ("no", "private"), ("yes", "true", "1"), ("-1", "reverse")
FOOT_FLAG, FOOT_CLOSED = ("demanding_mountain_hiking",), ("alpine_hiking", "demanding_alpine_hiking", "difficult_alpine_hiking")
BIKE_FLAG, BIKE_CLOSED = ("0", "1", "2", "3"), ("4", "5", "6")
FOOT, BIKE, TECHNICAL, TECHNICAL_BIKE = 1, 2, 1, 2


def tag(tags: Column, key: str) -> Column:
    """A tag's value, empty where it is missing."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def _number(value: Column, names: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def kind_of(tags: Column) -> Column:
    """Number of the way's kind, null for another highway or none."""
    order = list(KINDS)
    return _number(tag(tags, "highway"), {value: order.index(kind) for value, kind in HIGHWAYS.items()})


def surface_of(tags: Column) -> Column:
    """Number of the surface group, 0 where it is unknown."""
    order = list(SURFACES)
    return F.coalesce(_number(tag(tags, "surface"), {v: order.index(group) for group, values in SURFACE_VALUES.items() for v in values.split()}), F.lit(0))


def _any_of(tags: Column, key: str, values: tuple[str, ...]) -> Column:
    """Whether one of the ``;``-separated values of a tag is among ``values``."""
    return F.exists(F.split(tag(tags, key), ";"), lambda x: F.trim(x).isin(*values))


def bike_direction(tags: Column) -> tuple[Column, Column]:
    """Whether a bike may ride the way forward and backward."""
    oneway, own = tag(tags, "oneway"), tag(tags, "oneway:bicycle")

    def may(against_way: tuple[str, ...], with_own: tuple[str, ...], against_own: tuple[str, ...], lane: str) -> Column:
        by_own = F.when(own.isin(*with_own, "no"), True).when(own.isin(*against_own), False).otherwise(~oneway.isin(*against_way))
        return by_own | tag(tags, lane).startswith("opposite")

    return may(BACKWARD, TRUE, BACKWARD, "cycleway:forward"), may(TRUE, BACKWARD, TRUE, "cycleway:backward")


def classify_way(tags: Column) -> Column:
    """kind, surf, flags, modes, forward and backward of a way; null for one that no mode may use.

    access closes both modes unless a mode's own tag opens it; a trunk road and a motorroad close what no tag opens;
    stairs and footways are open to bikes by their tag alone; a scale flags a mode's use or closes it.
    """
    foot, bicycle, access, kind = tag(tags, "foot"), tag(tags, "bicycle"), tag(tags, "access"), kind_of(tags)
    of = lambda *names: kind.isin(*[list(KINDS).index(n) for n in names])
    foot_open, bike_open, shut = foot.isin(*OPEN), bicycle.isin(*OPEN), access.isin(*CLOSED)
    may_walk = (~shut | foot_open) & ~foot.isin(*CLOSED) & (~of("trunk") | foot_open) & ~(of("cycleway") & ~foot_open & (foot != ""))
    may_walk = may_walk & ~_any_of(tags, "sac_scale", FOOT_CLOSED)
    may_ride = (~shut | bike_open) & ~bicycle.isin(*CLOSED) & (~of("trunk") | bike_open) & (tag(tags, "motorroad") != "yes")
    may_ride = may_ride & (~of("footway", "steps", "pedestrian") | bike_open | (bicycle == "dismount")) & ~_any_of(tags, "mtb:scale", BIKE_CLOSED)
    bit = lambda on, value: F.when(on, value).otherwise(0)
    flags = bit(may_walk & _any_of(tags, "sac_scale", FOOT_FLAG), TECHNICAL) + bit(may_ride & _any_of(tags, "mtb:scale", BIKE_FLAG), TECHNICAL_BIKE)
    forward, backward = bike_direction(tags)
    row = F.struct(
        kind.alias("kind"), surface_of(tags).alias("surf"), flags.alias("flags"), (bit(may_walk, FOOT) + bit(may_ride, BIKE)).alias("modes"),
        (may_ride & forward).alias("forward"), (may_ride & backward).alias("backward"),
    )
    return F.when(kind.isNotNull() & (tag(tags, "area") != "yes") & (may_walk | may_ride), row)


def classify_poi(tags: Column) -> Column:
    """category (water, viewpoint, toilets) and seasonal of a point of interest; null for anything else."""
    drinking, seasonal = tag(tags, "drinking_water"), tag(tags, "seasonal")
    water = (drinking != "no") & ((tag(tags, "amenity") == "drinking_water") | (drinking == "yes"))
    toilets = (tag(tags, "amenity") == "toilets") & ~tag(tags, "access").isin("private", "no", "customers")
    kind = lambda name, on: F.struct(F.lit(name).alias("category"), on.alias("seasonal"))
    never = F.lit(False)
    return F.when(water, kind("water", (seasonal != "") & (seasonal != "no"))).when(tag(tags, "tourism") == "viewpoint", kind("viewpoint", never)).when(toilets, kind("toilets", never))
