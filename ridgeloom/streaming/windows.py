"""Requests in fixed windows, on a table or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(requests: DataFrame, key: str, ts: str = "ts", seconds: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """(start, key, n) of each fixed window; a stream gets a watermark, so its state ends with the window."""
    rows = requests.withColumn("_at", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", lateness)
    return rows.groupBy(F.window("_at", f"{seconds} seconds"), key).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("start"), key, "n")


def admitted(requests: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int = 600) -> DataFrame:
    """Requests with whether they are among the first ``limit`` of their key and window."""
    start = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    return requests.withColumn("admitted", F.row_number().over(Window.partitionBy(key, start).orderBy(ts, tie)) <= limit)
