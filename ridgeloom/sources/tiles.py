"""JSON bodies: coverage, tiles of points, places. A malformed body or item is null or left out, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("water", "viewpoint", "toilets")


def coverage(body: Column) -> Column:
    """Array of (west, south, east, north); null unless every cell has four numbers and an area."""
    cells = F.from_json(body, "cells array<array<double>>")["cells"]
    good = F.forall(cells, lambda c: (F.size(c) == 4) & F.forall(c, lambda v: v.isNotNull()) & F.coalesce((F.get(c, F.lit(0)) < F.get(c, F.lit(2))) & (F.get(c, F.lit(1)) < F.get(c, F.lit(3))), F.lit(False)))
    named = F.transform(cells, lambda c: F.struct(*[F.get(c, F.lit(k)).alias(n) for k, n in enumerate(("west", "south", "east", "north"))]))
    return F.when(good, named)


def _numeric(v: Column) -> Column:
    """Whether a JSON value is a number, not a text that reads like one."""
    return F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit("^(BIGINT|DOUBLE|DECIMAL)")), F.lit(False))


def _texts(v: Column, path: str) -> Column:
    """The value at a path if it is a text that is not empty, else null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))


def points(body: Column) -> Column:
    """Array of (category, lon, lat, seasonal, name) of the well-formed points of a tile, in their order.

    Each item is judged on its own, whatever stands beside it: an object with a known category and a position of exactly
    two numbers; seasonal if it is true, a name if it is a text that is not empty. Null for a body that is no object with
    a list, which holds no points.
    """
    pois = F.try_variant_get(F.try_parse_json(body), "$.pois", "array<variant>")
    place = lambda p: F.try_variant_get(p, "$.position", "array<variant>")
    good = F.filter(pois, lambda p: F.coalesce(_texts(p, "$.category").isin(*CATEGORIES) & (F.size(place(p)) == 2) & F.forall(place(p), _numeric), F.lit(False)))
    at = lambda p, k: F.try_variant_get(p, f"$.position[{k}]", "double")
    true = lambda p: F.coalesce((F.schema_of_variant(F.try_variant_get(p, "$.seasonal", "variant")) == "BOOLEAN") & F.try_variant_get(p, "$.seasonal", "boolean"), F.lit(False))
    return F.transform(good, lambda p: F.struct(_texts(p, "$.category").alias("category"), at(p, 0).alias("lon"), at(p, 1).alias("lat"), true(p).alias("seasonal"), _texts(p, "$.name").alias("name")))


def places(body: Column, most: int = 5) -> Column:
    """Array of (lon, lat, label) of the first features of a collection that have a position and a label."""
    found = F.from_json(body, "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<name: string, toponym: string, label: string>>>")["features"]
    label = lambda p: F.coalesce(p["properties"]["name"], p["properties"]["toponym"], p["properties"]["label"])
    at = lambda p, k: F.get(p["geometry"]["coordinates"], F.lit(k))
    good = F.filter(found, lambda p: at(p, 0).isNotNull() & at(p, 1).isNotNull() & label(p).isNotNull())
    return F.slice(F.transform(good, lambda p: F.struct(at(p, 0).alias("lon"), at(p, 1).alias("lat"), label(p).alias("label"))), 1, most)
