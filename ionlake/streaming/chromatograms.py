"""Streaming forms of scan operators: windowed totals with late data, and gap-cut sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_tic(points: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", time: str = "ts", key: str = "sample_id", value: str = "intensity") -> DataFrame:
    """Total and base peak intensity of each key and event-time window; works on streams and on tables."""
    return points.withWatermark(time, watermark).groupBy(key, F.window(time, window).alias("w")).agg(F.sum(value).alias("tic"), F.max(value).alias("bpi"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "tic", "bpi", "n")


def streaming_traces(points: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", time: str = "ts", key: str = "sample_id", value: str = "intensity") -> DataFrame:
    """Runs of a key's points without a gap, as a region of interest is cut when scans are missing."""
    s = F.session_window(time, gap).alias("s")
    return points.withWatermark(time, watermark).groupBy(key, s).agg(F.count("*").alias("n"), F.sum(value).alias("area"), F.max(value).alias("height")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "area", "height")
