"""Geometry on columns: distances, projections, cells. Angles are degrees, lengths metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, metres in a degree of the local plane, radius of the web map.
EARTH, PLANE_DEGREE, WEB_RADIUS = 6_371_008.8, 111_195.0, 6_378_137.0
#: Radius of the plane around a start, metres in a degree of areas.
START_RADIUS, AREA_DEGREE = 6_371_000.0, 111_194.9


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH * F.asin(F.when(half >= 1, 1.0).otherwise(F.sqrt(half)))  # null stays null


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in the local plane, at the mean latitude."""
    return F.hypot((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1) * PLANE_DEGREE


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of the origin from the segment a-b."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
    return F.hypot(ax + t * dx, ay + t * dy)


def web_tile(lat: Column, lon: Column, zoom: int = 10) -> tuple[Column, Column]:
    """Column and row of the web-map tile, held inside the map."""
    n = 1 << zoom
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    return inside(x), inside(y)


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * WEB_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * WEB_RADIUS


def grid_cell(lat_e7: Column, lon_e7: Column, low_lat: int, low_lon: int, across: int) -> Column:
    """Number of the index cell of 0.002 by 0.003 degrees, row by row from the south-west."""
    return (F.floor((lat_e7 - low_lat) / 20_000) * across + F.floor((lon_e7 - low_lon) / 30_000)).cast("long")


def coarse_cell(e7: Column) -> Column:
    """Index of the tenth of a degree, rounded down also below zero."""
    return F.floor(e7 / 1e6).cast("int")


def hilbert_key(x: Column, y: Column, bits: int = 16) -> Column:
    """Index of a cell along a Hilbert curve over a square of 2**bits cells a side."""
    start = F.struct(F.lit(0).cast("long").alias("key"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def level(acc: Column, k: Column) -> Column:
        s = F.pow(F.lit(2.0), k).cast("long")
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        low_x, low_y = acc["x"].bitwiseAND(s - 1), acc["y"].bitwiseAND(s - 1)
        turn, flip = ry == 0, (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - low_x).otherwise(low_x), F.when(flip, s - 1 - low_y).otherwise(low_y)
        step = s * s * F.when(rx == 1, 3 - ry).otherwise(ry)
        return F.struct((acc["key"] + step).alias("key"), F.when(turn, fy).otherwise(fx).alias("x"), F.when(turn, fx).otherwise(fy).alias("y"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda acc: acc["key"])


def lambert_constants() -> tuple[float, float, float, float, float]:
    """Exponent, scale, first eccentricity, origin's longitude and y of the pole of the French conic projection."""
    a, f = 6_378_137.0, 1 / 298.257222101
    e = math.sqrt(2 * f - f * f)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = (math.radians(d) for d in (46.5, 44.0, 49.0))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    scale = a * m(p1) / (n * t(p1) ** n)
    return n, scale, e, math.radians(3.0), 6_600_000 + scale * t(p0) ** n


def lambert93(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of EPSG:2154."""
    n, scale, e, lon0, pole = lambert_constants()
    s = e * F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, theta = scale * F.pow(t, F.lit(n)), n * (F.radians(lon) - lon0)
    return 700_000 + rho * F.sin(theta), pole - rho * F.cos(theta)


def slope_weight(grade: Column) -> Column:
    """Walking effort of a grade against the flat: easiest slightly downhill, grades held within 0.4."""
    held = F.greatest(F.lit(-0.4), F.least(F.lit(0.4), grade))
    return F.exp(3.5 * (F.abs(held + 0.05) - 0.05))


def quantized(cost: Column, unit: int = 16) -> Column:
    """Cost in units, 65535 for what is farther or unreachable."""
    return F.coalesce(F.least(F.floor(cost / unit), F.lit(65_535)), F.lit(65_535)).cast("int")


def metres_from(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Metres east and north of a start."""
    return F.radians(lon - lon0) * START_RADIUS * F.cos(F.radians(lat0)), F.radians(lat - lat0) * START_RADIUS


def utm(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of a transverse Mercator zone (1 to 60), by Krueger's series to the fourth power."""
    if not 1 <= zone <= 60:
        raise ValueError(f"no zone {zone}")
    f = 1 / 298.257222101
    n = f / (2 - f)
    scale = 0.9996 * WEB_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    waves = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49_561 * n**4 / 161_280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    across = F.radians(lon - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(across)), F.atanh(F.sin(across) / F.hypot(F.lit(1.0), t))
    x, y = eta, xi
    for k, wave in enumerate(waves, 1):
        x = x + wave * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + wave * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + scale * x, (10_000_000 if south else 0) + scale * y


def box_margin(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Metres from a point to the nearest side of a box, below zero outside."""
    narrow = F.cos(F.radians(lat))
    return F.least(lat - south, north - lat, (lon - west) * narrow, (east - lon) * narrow) * AREA_DEGREE


def circle_polygon(lat: Column, lon: Column, radius: Column, steps: int = 64) -> Column:
    """Closed ring of (lon, lat) around a point."""

    def at(i: Column) -> Column:
        angle = (i % steps) / steps * 2 * math.pi
        return F.struct((lon + radius * F.cos(angle) / (AREA_DEGREE * F.cos(F.radians(lat)))).alias("lon"), (lat + radius * F.sin(angle) / AREA_DEGREE).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def fitted_radius(asked: Column, nearest: Column, margin: int = 1, step: int = 10, least: int = 50) -> Column:
    """The radius asked for, stopped short of the nearest point and rounded down to a step, but never under the least."""
    return F.greatest(F.lit(least), F.floor(F.least(asked, F.floor(nearest) - margin) / step) * step)


def grid_point(x: Column, low: Column, cell: Column) -> tuple[Column, Column]:
    """The raster cell whose centre lies at or before x, and how far x is past it as a share of a cell (float)."""
    f = (x - low) / cell - 0.5
    return F.floor(f), (f - F.floor(f)).cast("float")


def raster_tile_key(i: Column, j: Column, across: int, down: int) -> Column:
    """Number of the tile of a raster cell, by row from the south, then from the west; cells outside share the outer ring."""
    part = lambda v: F.greatest(F.lit(0), F.least(F.lit(0xFFFF), v + 1))
    return F.shiftleft(part(F.floor(j / down)), 16) + part(F.floor(i / across))
