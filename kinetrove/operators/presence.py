"""Who is in the frame and who is in the region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance, inside


def seen(mode: str = "truthy") -> Column:
    """Whether a row holds a coordinate: not zero (``truthy``), or merely present (``notnull``)."""
    x, y = F.col("x"), F.col("y")
    if mode == "truthy":
        return F.coalesce(x != 0, F.lit(False)) | F.coalesce(y != 0, F.lit(False))
    return x.isNotNull() | y.isNotNull()


def frames(pose: DataFrame) -> DataFrame:
    return pose.select("clip", "frame").distinct()


def nfish_frame(pose: DataFrame, mode: str = "truthy") -> DataFrame:
    """(clip, frame, nfish_frame) for every frame."""
    fish = pose.groupBy("clip", "frame", "individual").agg(F.bool_or(seen(mode)).alias("here"))
    return fish.groupBy("clip", "frame").agg(F.count_if("here").alias("nfish_frame"))


def nfish_pipe(pose: DataFrame, roi: DataFrame, inclusive: bool = True, bodypart: str = "stripe1") -> DataFrame:
    """(clip, frame, nfish_pipe): individuals whose body part lies in the region; NULL for a clip without one.

    One pass: the body part is picked inside the aggregate, so frames without it keep their zero.
    """
    at = pose.join(roi.select("clip", "roi_x", "roi_y", "roi_r"), "clip", "left")
    dist = distance(F.col("x") - F.col("roi_x"), F.col("y") - F.col("roi_y"))
    count = F.count_if((F.col("bodypart") == bodypart) & inside(dist, "roi_r", inclusive))
    out = at.groupBy("clip", "frame").agg(count.alias("nfish_pipe"), F.max("roi_r").alias("_r"))
    return out.select("clip", "frame", F.when(F.col("_r").isNotNull(), F.col("nfish_pipe")).alias("nfish_pipe"))


def in_roi(pose: DataFrame, roi: DataFrame, inclusive: bool = False, bodypart: str = "stripe1") -> DataFrame:
    """(clip, frame, individual, in_roi) for every individual of every frame."""
    at = pose.join(roi.select("clip", "roi_x", "roi_y", "roi_r"), "clip", "left")
    dist = distance(F.col("x") - F.col("roi_x"), F.col("y") - F.col("roi_y"))
    held = F.bool_or((F.col("bodypart") == bodypart) & inside(dist, "roi_r", inclusive))
    return at.groupBy("clip", "frame", "individual").agg(F.coalesce(held, F.lit(False)).alias("in_roi"))


def occupancy_fractions(counts: DataFrame, most: int = 3) -> DataFrame:
    """Share of each count 0..most among the clip's frames that have one; larger counts stay in the denominator."""
    names = ["zero", "single", "double", "triple"]
    n = F.count("nfish_pipe")
    share = [F.try_divide(F.count_if(F.col("nfish_pipe") == k).cast("double"), n).alias(f"raw_{names[k]}_occupancy_fraction") for k in range(most + 1)]
    return counts.groupBy("clip").agg(*share)


def to_roi(pose: DataFrame, roi: DataFrame) -> DataFrame:
    """The pose with the region's centre as origin."""
    at = pose.join(roi.select("clip", "roi_x", "roi_y"), "clip", "left")
    return at.withColumns({"x": F.col("x") - F.col("roi_x"), "y": F.col("y") - F.col("roi_y")}).drop("roi_x", "roi_y")
