"""ASCII height grids: six header lines, then rows of values from the north."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize")
_HEADER = r"^\s*([A-Za-z_]+)\s+(\S+)\s*$"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of all grids below a folder, plain or gzipped, whatever the case of their endings."""
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{asc,ASC,Asc,asc.gz,ASC.GZ}")
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def header(body: Column) -> Column:
    """The header's entries by lower-case key, as a map of text; nodata_value is 0 where it is missing."""
    lines = F.slice(F.split(body, r"\r?\n"), 1, 6)
    named = F.filter(lines, lambda x: x.rlike(_HEADER))
    entries = F.transform(named, lambda x: F.struct(F.lower(F.regexp_extract(x, _HEADER, 1)).alias("key"), F.regexp_extract(x, _HEADER, 2).alias("value")))
    return F.map_concat(F.map_from_entries(F.filter(F.array(F.struct(F.lit("nodata_value").alias("key"), F.lit("0").alias("value"))), lambda e: ~F.exists(entries, lambda x: x["key"] == "nodata_value"))), F.map_from_entries(entries))


def grids(texts: DataFrame) -> DataFrame:
    """(path, ncols, nrows, xllcorner, yllcorner, cellsize, values) of files (path, body); values run west to east from the north, null for no data.

    A file without one of the required keys, or with another number of values than rows times columns, is an error that names it.
    """
    rows = texts.withColumn("h", header(F.col("body"))).withColumn("lines", F.size(F.filter(F.slice(F.split("body", r"\r?\n"), 1, 6), lambda x: x.rlike(_HEADER))))
    number = lambda k, kind: F.coalesce(F.try_element_at("h", F.lit(k)).cast(kind), F.raise_error(F.concat(F.col("path"), F.lit(f" has no {k}"))).cast(kind))
    kinds = ("int", "int", "double", "double", "double")
    plain = rows.select("path", *[number(k, t).alias(k) for k, t in zip(_KEYS, kinds, strict=True)], F.col("h")["nodata_value"].cast("double").alias("nodata"), F.array_join(F.expr("slice(split(body, '\\r?\\n'), lines + 1, size(split(body, '\\n')))"), " ").alias("rest"))
    values = F.transform(F.filter(F.split("rest", r"\s+"), lambda v: v != ""), lambda v: F.nullif(v.cast("double"), F.col("nodata")))
    read = plain.withColumn("values", values)
    wrong = F.size("values") != F.col("ncols") * F.col("nrows")
    return read.select("path", *_KEYS, F.when(wrong, F.raise_error(F.concat(F.col("path"), F.lit(" has another number of values")))).otherwise(F.col("values")).alias("values"))


def cells(read: DataFrame) -> DataFrame:
    """(path, gi, gj, z) of grids, gi from the west and gj from the south of one common lattice; all grids must have one cell size."""
    low = read.agg(F.min("xllcorner").alias("x0"), F.min("yllcorner").alias("y0"), F.min("cellsize").alias("c0"), F.max("cellsize").alias("c1"))
    one = low.select("x0", "y0", F.when(F.col("c0") == F.col("c1"), F.col("c0")).otherwise(F.raise_error(F.lit("grids of different cell sizes"))).alias("size"))
    at = lambda corner, start: F.round((F.col(corner) - F.col(start)) / F.col("size")).cast("long")
    each = read.join(F.broadcast(one)).select("path", "ncols", "nrows", at("xllcorner", "x0").alias("i0"), at("yllcorner", "y0").alias("j0"), F.posexplode("values").alias("k", "z"))
    return each.select("path", (F.col("i0") + F.col("k") % F.col("ncols")).alias("gi"), (F.col("j0") + F.col("nrows") - 1 - F.floor(F.col("k") / F.col("ncols"))).alias("gj"), "z")


def body(ncols: Column, nrows: Column, x: Column, y: Column, size: Column, values: Column, nodata: str = "-9999") -> Column:
    """The text of a grid."""
    head = F.format_string("ncols %d\nnrows %d\nxllcorner %s\nyllcorner %s\ncellsize %s\nNODATA_value %s\n", ncols, nrows, x.cast("string"), y.cast("string"), size.cast("string"), F.lit(nodata))
    return F.concat(head, F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(nodata))), " "), F.lit("\n"))
