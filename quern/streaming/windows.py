"""Windowed counts over event streams, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str, kind: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, kind, n) per window of LENGTH; works on a table as on a stream, where rows later than DELAY are left to the watermark."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", delay)
    out = rows.groupBy(F.window("_t", length).alias("w"), F.col(kind)).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), kind, "n")


def activity_sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of rows of a key with less than GAP between neighbours."""
    rows = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_t", delay)
    out = rows.groupBy(F.session_window("_t", gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
