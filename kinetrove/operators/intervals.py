"""Annotated intervals on frames, and segments on pose and features.

Segments meet rows by bins of frames. Annotations, which overlap, are spelt out as the frames that they cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_frames
from ..sources.keys import frame_range, trial
from .overlaps import within


def covered(intervals: DataFrame, spans: int | DataFrame, mode: str = "strict") -> DataFrame:
    """(by..., frame) of the frames that intervals (start, stop in frames) cover, each once.

    ``spans``: the number of frames, from 0 on, or (by..., first, last) with the range of each clip. Empty intervals cover nothing.
    strict: ends count where first < t < last; stop is exclusive; an interval open at the right stops before
    the last frame, and one open at both sides covers nothing. inclusive: start .. stop, both included.
    """
    by = [c for c in intervals.columns if c not in ("start", "stop")]
    if isinstance(spans, int):
        intervals = intervals.withColumns({"_first": F.lit(0), "_last": F.lit(spans - 1)})
    else:
        ends = spans.withColumnsRenamed({"first": "_first", "last": "_last"})
        intervals = intervals.join(ends, [c for c in by if c in spans.columns])
    first, last = F.col("_first"), F.col("_last")
    if mode == "strict":
        begins, ends = [(F.col(c) > first) & (F.col(c) < last) for c in ("start", "stop")]
        lo = F.when(begins, F.col("start")).when(ends, first)
        hi = F.when(begins & ends, F.col("stop")).when(begins, last).when(ends, F.col("stop")) - 1
    else:  # a missing end leaves the comparison unknown, where greatest and least would skip it
        lo, hi = F.when(F.col("start").isNotNull(), F.greatest("start", first)), F.when(F.col("stop").isNotNull(), F.least("stop", last))
    rows = intervals.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")}).where("_lo <= _hi")
    return rows.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("frame")).distinct()


def marked(frames: DataFrame, cover: DataFrame, by: list[str], name: str = "quivering") -> DataFrame:
    """Adds a boolean: whether the frame is covered."""
    hit = cover.select(*by, F.lit(True).alias(name))
    return frames.join(hit, by, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def of_clips(annotations: DataFrame, clips: DataFrame, fps: int = 30) -> DataFrame:
    """(clip, start, stop): a trial's annotations in seconds as frames of each of its clips, shifted and clipped to [0, length]."""
    first, last = frame_range(F.col("clip"))
    at = clips.select("clip", trial(F.col("clip")).alias("trial"), first.alias("first"), last.alias("last"))
    rows = annotations.select("trial", to_frames(F.col("temporal_segment_start"), fps).alias("start"), to_frames(F.col("temporal_segment_end"), fps).alias("stop"))
    rows = rows.join(at, "trial").withColumn("length", F.col("last") - F.col("first"))
    rows = rows.withColumns({"start": F.col("start") - F.coalesce("first", F.lit(0)), "stop": F.col("stop") - F.coalesce("first", F.lit(0))})
    rows = rows.where("stop >= 0 and (length is null or start <= length)")
    return rows.select("clip", F.greatest("start", F.lit(0)).alias("start"), F.when(F.col("length").isNull(), F.col("stop")).otherwise(F.least("stop", "length")).alias("stop"))


def segmented(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (clip, individual, frame, ...) with the segment (start, stop) of their individual that holds them."""
    return within(rows, segments.select("clip", "individual", "start", "stop"), ["clip", "individual"])


def segmented_features(features: DataFrame, global_features: DataFrame, segments: DataFrame) -> DataFrame:
    """``segmented`` features together with the frame-wide ones."""
    return segmented(features, segments).join(global_features, ["clip", "frame"], "left")
