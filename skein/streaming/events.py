"""Event matrices from a stream: late data up to a watermark, windows closed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str = "ts", node: str = "event_type", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """``node, start, n`` of each window; rows later than ``delay`` are dropped by the watermark. Works on batches too."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), F.col(node).alias("node")).agg(F.count("*").alias("n")).select("node", F.col("window.start").alias("start"), "n")


def event_flags(counts: DataFrame, threshold: float) -> DataFrame:
    """``node, start, flag``: windows with more than ``threshold`` events."""
    return counts.select("node", "start", (F.col("n") > threshold).cast("int").alias("flag"))
