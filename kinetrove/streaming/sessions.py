"""An extension: density clusters with one sample are sessions, and sessions can be streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_sessions(events: DataFrame, value: str, thresh: float, gap: str, time: str = "ts", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """(by..., start, stop, n): runs of hits whose gaps are below ``gap``; batch or streaming, late rows up to the watermark."""
    hits = events.where(F.col(value) < thresh).withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        hits = hits.withWatermark(time, late)
    found = hits.groupBy(*(by or []), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*(by or []), F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
