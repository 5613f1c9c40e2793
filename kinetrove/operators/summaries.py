"""Summary tables over events, tracks, segments, trials and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import mean_heading
from .quantiles import group_quantiles


def lengths(rows: DataFrame, length, prefix: str, std: bool = True, by: list[str] | None = None) -> DataFrame:
    """Count, mean, max, min, median and population deviation of a length; over no rows only the count has a value."""
    v = rows.withColumn("_v", length)
    aggs = [F.count("_v").alias(f"n_{prefix}"), F.avg("_v").alias("mean_len"), F.max("_v").alias("max_len"), F.min("_v").alias("min_len"), F.median("_v").alias("med_len")]
    return v.groupBy(*(by or [])).agg(*aggs, *([F.stddev_pop("_v").alias("std_len")] if std else []))


def event_counts(features: DataFrame, labels: list[str]) -> DataFrame:
    """(clip, n_<label>): the largest id plus one; ids are contiguous from 0."""
    return features.groupBy("clip").agg(*[(F.max(c) + 1).alias(f"n_{c}") for c in labels])


def event_fractions(features: DataFrame, labels: list[str]) -> DataFrame:
    """(clip, <label>_fraction): share of all rows of the clip that lie in an event."""
    return features.groupBy("clip").agg(*[F.try_divide(F.count_if(F.col(c) >= 0).cast("double"), F.count(F.lit(1))).alias(f"{c}_fraction") for c in labels])


def annotation_counts(annotations: DataFrame, trials: list[str]) -> DataFrame:
    """(trial, n) of the named trials, 0 where a trial has none."""
    names = annotations.sparkSession.createDataFrame([(t,) for t in trials], "trial string")
    found = annotations.where("temporal_segment_end - temporal_segment_start is not null").groupBy("trial").agg(F.count(F.lit(1)).alias("n"))
    return names.join(found, "trial", "left").select("trial", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def annotation_quartiles(annotations: DataFrame) -> DataFrame:
    """(trial, n, q25, q50, q75) of annotation lengths; a trial without a whole annotation has n = 0."""
    length = annotations.select("trial", (F.col("temporal_segment_end") - F.col("temporal_segment_start")).alias("length"))
    found = group_quantiles(length, ["trial"], "length", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return length.select("trial").distinct().join(found, "trial", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def rmse_per_bodypart(errors: DataFrame) -> DataFrame:
    return errors.groupBy("bodypart").agg(F.count("rmse").alias("n"), F.avg("rmse").alias("mean_rmse"))


def average_heading(rows: DataFrame, by: list[str], column: str = "heading") -> DataFrame:
    return rows.groupBy(*by).agg(mean_heading(F.col(column)).alias("avg_heading"))


def collated(segments: DataFrame) -> DataFrame:
    """One row: clips, segments, segments a clip, mean, median and least length, total frames."""
    return segments.agg(
        F.count_distinct("clip").alias("n_videos"), F.count(F.lit(1)).alias("n_segments"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("clip")).alias("avg_segments_per_video"),
        F.avg("n").alias("avg_len"), F.median("n").alias("med_len"), F.min("n").alias("min_len"), F.sum("n").alias("total_frames"),
    )


def exclusion_stats(excluded: DataFrame) -> DataFrame:
    v = "excluded_proportion"
    return excluded.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
