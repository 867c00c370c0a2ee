"""GPX tracks as columns: reading of the points in a document, writing of one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = r"(?s)<{0}\b[^>]*?(?:/>|>.*?</{0}>)"
_MARKUP = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escaped(text: Column) -> Column:
    """A text without markup."""
    for plain, entity in _MARKUP:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def cleaned(text: Column, most: int = 100) -> Column:
    """White space collapsed and trimmed, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def points(document: Column) -> Column:
    """Array of (lon, lat, ele) of a document's track points, else of its route points; null where it has none or one is no position.

    Heights are kept only if every point has one.
    """

    def read(name: str) -> Column:
        found = F.regexp_extract_all(document, F.lit(_POINT.format(name)), 0)
        value = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double")
        return F.transform(found, lambda x: F.struct(value(x, r"""\blon\s*=\s*["']([^"']*)["']""").alias("lon"), value(x, r"""\blat\s*=\s*["']([^"']*)["']""").alias("lat"), value(x, r"<ele>\s*([^<\s]*)\s*</ele>").alias("ele")))

    track, route = read("trkpt"), read("rtept")
    every = F.when(F.size(track) > 0, track).otherwise(route)
    bad = F.exists(every, lambda p: p["lon"].isNull() | p["lat"].isNull() | (F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90))
    whole = F.forall(every, lambda p: p["ele"].isNotNull())
    heights = F.transform(every, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), F.when(whole, p["ele"]).alias("ele")))
    return F.when((F.size(every) > 0) & ~bad, heights)


def document(name: Column, track: Column) -> Column:
    """A GPX 1.1 document of a track's points (lon, lat, ele or null), with six decimals and heights with one."""

    def point(p: Column) -> Column:
        height = F.coalesce(F.concat(F.lit("<ele>"), F.format_string("%.1f", p["ele"]), F.lit("</ele>")), F.lit(""))
        return F.concat(F.format_string('<trkpt lat="%.6f" lon="%.6f">', p["lat"], p["lon"]), F.when(p["ele"].isNull(), "").otherwise(height), F.lit("</trkpt>"))

    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">\n<trk><name>'
    return F.concat(F.lit(head), escaped(name), F.lit("</name><trkseg>\n"), F.array_join(F.transform(track, point), "\n"), F.lit("\n</trkseg></trk>\n</gpx>\n"))
