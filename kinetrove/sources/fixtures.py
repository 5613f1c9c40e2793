"""Pose, signal and annotation tables derived from the driver's tables by integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import BODYPARTS

ROI_X, ROI_Y, ROI_R = 360.0, 450.0, 60.0
FRAME_W, FRAME_H = 720, 900
ANNOTATED = 1.0


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, individual, bodypart, x, y): 27 points a vector, with gaps."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    point = F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda j: F.struct(j.alias("j"), F.get("embedding", 2 * j).cast("double").alias("vx"), F.get("embedding", 2 * j + 1).cast("double").alias("vy"))))
    v = v.select("vec_id", point.alias("p")).select("vec_id", "p.*")
    ind, bp, b = F.expr("j div 9 + 1"), F.col("j") % 9, F.expr("vec_id div 20")
    gone = ((b + ind) % 5 == 0) | ((b + 2 * ind) % 7 == 0) | ((F.col("vec_id") + 3 * bp + 5 * ind) % 61 == 0)
    names = F.array(*[F.lit(x) for x in BODYPARTS])
    return v.select(
        F.concat(F.lit("clip"), F.expr("vec_id div 250").cast("string")).alias("clip"),
        F.col("vec_id").cast("bigint").alias("frame"),
        F.concat(F.lit("individual"), ind.cast("string")).alias("individual"),
        F.get(names, bp).alias("bodypart"),
        F.when(~gone, 360 + 300 * F.col("vx")).alias("x"),
        F.when(~gone, 450 + 300 * F.col("vy")).alias("y"),
    )


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.concat(F.lit("clip"), F.expr("vec_id div 250").cast("string")).alias("clip")).distinct()
    return clips.select("clip", F.lit(ROI_X).alias("roi_x"), F.lit(ROI_Y).alias("roi_y"), F.lit(ROI_R).alias("roi_r"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, cx, cy, red, green, blue): a column of 21 pixels a vector."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    shade = lambda at: F.floor(128 + 400 * F.get("embedding", at).cast("double"))
    point = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.struct(j.alias("cy"), *[shade(3 * j + k).alias(c) for k, c in enumerate(("red", "green", "blue"))]))).alias("p")
    clip = F.concat(F.lit("clip"), F.expr("vec_id div 250").cast("string")).alias("clip")
    return v.select(clip, (F.col("vec_id") % 250).cast("int").alias("cx"), point).select("clip", "cx", "p.*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, dist): one dense clip."""
    return events(spark, sf_dir).select(F.lit("signal").alias("clip"), F.col("event_id").cast("bigint").alias("frame"), F.col("value").alias("dist"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, value, heading): a clip a user, with gaps between frames."""
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("clip"), F.col("event_id").cast("bigint").alias("frame"), "value", F.pmod(F.col("value") * 7, F.lit(360.0)).alias("heading"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, start, stop) in frames, stop exclusive. Every event is a row of the annotation sheet; low values are annotations of 20 frames, other rows are empty."""
    low = F.col("value") < ANNOTATED
    clip = F.concat(F.lit("clip"), F.expr("event_id div 250").cast("string")).alias("clip")
    return events(spark, sf_dir).select(clip, F.when(low, F.col("event_id").cast("bigint")).alias("start"), F.when(low, (F.col("event_id") + 20).cast("bigint")).alias("stop"))


def annotation_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, temporal_segment_start, temporal_segment_end) in seconds, with empty rows and annotations that lack an end."""
    low, frame = F.col("value") < ANNOTATED, F.col("event_id")
    trial = F.concat(F.lit("BHVE_group"), F.expr("event_id div 97 % 4").cast("string"))
    end = F.when(low & (frame % 5 != 0), (frame + 20 + frame % 7) / 30)
    return events(spark, sf_dir).select(trial.alias("trial"), F.when(low, frame / 30).alias("temporal_segment_start"), end.alias("temporal_segment_end"))
