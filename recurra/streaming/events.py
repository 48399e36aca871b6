"""Event-time forms of the running scores under Structured Streaming: watermarks, windows, sessions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_accuracy(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Accuracy per stream and event-time window; log has ts, stream_id, is_correct. Rows later than `late` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return log.withWatermark("ts", late).groupBy("stream_id", w.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.avg("is_correct").alias("accuracy"))


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and errors per stream and session of activity."""
    return log.withWatermark("ts", late).groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum(1 - F.col("is_correct")).alias("errors"))


def once(log: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
