"""Pose refinement, group segments and what refinement leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .overlaps import within
from .presence import seen
from .scans import CHUNK, previous, running_sum
from .sequences import islands, runs


def refine(pose: DataFrame, min_keypoints: int = 4, border: float = 0, min_track_len: int = 10, width: int = 720, height: int = 900) -> DataFrame:
    """The pose with a fish's points NULL in frames where it has too few, touches the border, or (after those) stays too briefly."""
    fish = Window.partitionBy("clip", "frame", "individual")
    out = (F.col("x") < border) | (F.col("y") < border) | (F.col("x") > width - border) | (F.col("y") > height - border)
    few = F.count("x").over(fish) < min_keypoints
    edge = F.coalesce(F.bool_or(out).over(fish), F.lit(False))
    rows = pose.withColumn("_gone", few | edge)
    rows = rows.withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in ("x", "y")}).drop("_gone")
    held = rows.groupBy("clip", "frame", "individual").agg(F.bool_or(F.coalesce(F.col("x") != 0, F.lit(False))).alias("here")).where("here")
    marked = islands(held.select("clip", "individual", "frame"), ["clip", "individual"])
    long = marked.groupBy("clip", "individual", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_track_len).select("clip", "individual", "run")
    keep = marked.join(long, ["clip", "individual", "run"], "left_semi").select("clip", "individual", "frame", F.lit(True).alias("_keep"))
    rows = rows.join(keep, ["clip", "individual", "frame"], "left")
    return rows.withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in ("x", "y")}).drop("_keep")


def group_segments(pose: DataFrame, min_len: int = 60, whole: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(clip, segment_id, start, stop, n): occupied runs, split where a fish appears (unless all are then there), long ones numbered."""
    fish = pose.groupBy("clip", "frame", "individual").agg(F.bool_or(seen()).alias("here"))
    count = fish.groupBy("clip", "frame").agg(F.count_if("here").alias("nfish")).where("nfish > 0")
    rows = islands(count, ["clip"], chunk=chunk)
    long = rows.groupBy("clip", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_len).select("clip", "run")
    rows = previous(rows.join(long, ["clip", "run"], "left_semi"), ["clip"], ["run", "nfish"], chunk=chunk)
    rise = (F.col("previous_run") == F.col("run")) & (F.col("nfish") > F.col("previous_nfish")) & (F.col("nfish") != whole)
    rows = running_sum(rows, ["clip"], F.coalesce(rise, F.lit(False)).cast("bigint"), "part", chunk=chunk)
    parts = rows.groupBy("clip", "run", "part").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_len)
    number = F.row_number().over(Window.partitionBy("clip").orderBy("start")) - 1  # one row a segment
    return parts.select("clip", number.cast("bigint").alias("segment_id"), "start", "stop", "n")


def with_segment_id(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds segment_id, -1 outside all segments."""
    found = within(frames, segments.select("clip", "segment_id", "start", "stop"), ["clip"], how="left")
    return found.withColumn("segment_id", F.coalesce("segment_id", F.lit(-1).cast("bigint"))).drop("start", "stop")


def excluded(pose: DataFrame, segments: DataFrame) -> DataFrame:
    """(clip, n_original, n_kept, excluded_proportion): occupied frames before, segment frames after."""
    held = pose.groupBy("clip", "frame").agg(F.bool_or(seen()).alias("here"))
    before = held.groupBy("clip").agg(F.count_if("here").alias("n_original"))
    after = segments.groupBy("clip").agg(F.sum("n").alias("n_kept"))
    out = before.join(after, "clip", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("bigint")))
    return out.withColumn("excluded_proportion", F.try_divide((F.col("n_original") - F.col("n_kept")).cast("double"), F.col("n_original")))


def tracks(pose: DataFrame) -> DataFrame:
    """(clip, individual, start, stop, n): runs of frames in which a fish has any point."""
    held = pose.groupBy("clip", "individual", "frame").agg(F.bool_or(seen("notnull")).alias("here")).where("here")
    return runs(held, ["clip", "individual"])


def segments(pose: DataFrame, min_len: int = 60) -> DataFrame:
    """(clip, individual, start, stop): tracks of at least ``min_len`` frames."""
    return tracks(pose).where(F.col("n") >= min_len).select("clip", "individual", "start", "stop")
