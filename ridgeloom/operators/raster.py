"""Rasters of heights as rows (gi, gj, z): overlapping files, bilinear samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeloom.functions import geo


def merged(cells: DataFrame) -> DataFrame:
    """(gi, gj, z) of cells (file_no, gi, gj, z): the first file with a height there, null where none has one.

    A partial minimum, so that a cell in many files costs no sort.
    """
    known = F.min(F.when(F.col("z").isNotNull(), F.struct("file_no", "z")))
    return cells.groupBy("gi", "gj").agg(known.getField("z").alias("z"))


def sampled(points: DataFrame, cells: DataFrame, low_x: float, low_y: float, size: float) -> DataFrame:
    """(id, z) of each point (id, x, y): the blend of the four cells around it in single precision, null where one has no height.

    Each point meets its four cells by equi-join; heights are put together again by point, so nothing is broadcast.
    """
    (i, tx), (j, ty) = geo.grid_point(F.col("x"), F.lit(low_x), F.lit(size)), geo.grid_point(F.col("y"), F.lit(low_y), F.lit(size))
    corners = F.array(*[F.struct((i + a).alias("gi"), (j + b).alias("gj"), F.lit(2 * b + a).alias("corner")) for a in (0, 1) for b in (0, 1)])
    asked = points.select("id", tx.alias("tx"), ty.alias("ty"), F.explode(corners).alias("c")).select("id", "tx", "ty", "c.*")
    found = asked.join(cells.where("z is not null").select("gi", "gj", F.col("z").cast("float").alias("z")), ["gi", "gj"], "left")
    at = [F.max(F.when(F.col("corner") == k, F.col("z"))) for k in range(4)]
    four = found.groupBy("id", "tx", "ty").agg(*[c.alias(n) for c, n in zip(at, "abce", strict=True)])
    a, b, c, e, tx, ty = (F.col(n) for n in ("a", "b", "c", "e", "tx", "ty"))
    bottom, top = a + (b - a) * tx, c + (e - c) * tx
    return four.select("id", (bottom + (top - bottom) * ty).alias("z"))
