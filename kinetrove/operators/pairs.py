"""Distances and angles between points of one frame.

All joins are equi-joins on (clip, frame) between sides already cut down to the
rows that can pair, at most one row a fish (or a point) and frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angle, distance
from .presence import frames, nfish_frame


def side(pose: DataFrame, name: str, keep: Column | None = None, keys: tuple[str, ...] = ("individual",)) -> DataFrame:
    rows = pose.where(keep) if keep is not None else pose
    return rows.select("clip", "frame", *[F.col(k).alias(f"{k}_{name}") for k in keys], F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"))


def between() -> Column:
    return distance(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))


def ordered_pairs(pose: DataFrame, part_a: str, part_b: str) -> DataFrame:
    """(clip, frame, individual_a, individual_b, dist): part a of one fish to part b of every other."""
    a = side(pose, "a", F.col("bodypart") == part_a)
    b = side(pose, "b", F.col("bodypart") == part_b)
    return a.join(b, ["clip", "frame"]).where("individual_a <> individual_b").select("clip", "frame", "individual_a", "individual_b", between().alias("dist"))


def min_distance(pose: DataFrame, part_a: str = "nose", part_b: str = "stripe4", name: str = "min_dist") -> DataFrame:
    """(clip, frame, min_dist) for every frame; NULL where no pair has both points."""
    least = ordered_pairs(pose, part_a, part_b).groupBy("clip", "frame").agg(F.min("dist").alias(name))
    return frames(pose).join(least, ["clip", "frame"], "left")


def same_part_distances(pose: DataFrame, least_fish: int = 2) -> DataFrame:
    """(clip, frame, individual_a, individual_b, bodypart, dist) in frames with enough fish."""
    busy = nfish_frame(pose).where(F.col("nfish_frame") >= least_fish).select("clip", "frame")
    rows = pose.join(busy, ["clip", "frame"], "left_semi")
    a = rows.select("clip", "frame", "bodypart", F.col("individual").alias("individual_a"), F.col("x").alias("x_a"), F.col("y").alias("y_a"))
    b = rows.select("clip", "frame", "bodypart", F.col("individual").alias("individual_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    return a.join(b, ["clip", "frame", "bodypart"]).where("individual_a < individual_b").select("clip", "frame", "individual_a", "individual_b", "bodypart", between().alias("dist"))


def all_distances(pose: DataFrame) -> DataFrame:
    """(clip, frame, point_a, point_b, dist) of all unordered point pairs, 351 a frame with 27 points.

    A frame's points, a fixed number, are gathered by one aggregate and paired in place: no join, and no pair is formed twice.
    """
    point = F.struct(F.concat_ws(":", "individual", "bodypart").alias("point"), "x", "y")
    points = pose.groupBy("clip", "frame").agg(F.sort_array(F.collect_list(point)).alias("p"))
    first = points.select("clip", "frame", F.posexplode("p").alias("i", "a"), "p")
    later = F.explode(F.slice("p", F.col("i") + 2, F.greatest(F.size("p") - F.col("i") - 1, F.lit(0)))).alias("b")
    pairs = first.select("clip", "frame", "a", later)
    pairs = pairs.select("clip", "frame", F.col("a.point").alias("point_a"), F.col("b.point").alias("point_b"), *[F.col(f"{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in "xy"])
    return pairs.select("clip", "frame", "point_a", "point_b", between().alias("dist"))


def skeleton_angles(pose: DataFrame, skeleton: list[tuple[str, str]]) -> DataFrame:
    """(clip, frame, individual, part_a, part_b, angle) of each configured part pair: the direction from b to a.

    The few pairs are picked per (frame, fish) by one aggregate, without a join.
    """
    parts = sorted({p for pair in skeleton for p in pair})
    fish = pose.where(F.col("bodypart").isin(parts)).groupBy("clip", "frame", "individual")
    flat = fish.agg(*[F.max(F.when(F.col("bodypart") == p, F.col(c))).alias(f"{p}_{c}") for p in parts for c in ("x", "y")])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("part_a"), F.lit(b).alias("part_b"), angle(F.col(f"{a}_y") - F.col(f"{b}_y"), F.col(f"{a}_x") - F.col(f"{b}_x")).alias("angle")) for a, b in skeleton]))
    return flat.select("clip", "frame", "individual", rows.alias("s")).select("clip", "frame", "individual", "s.*")


def intercentroid_angles(centroids: DataFrame) -> DataFrame:
    """(clip, frame, individual_a, individual_b, angle): the direction from b's centroid to a's."""
    rows = centroids.select("clip", "frame", "individual", F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"))
    a, b = side(rows, "a"), side(rows, "b")
    turn = angle(F.col("y_a") - F.col("y_b"), F.col("x_a") - F.col("x_b"))
    return a.join(b, ["clip", "frame"]).where("individual_a < individual_b").select("clip", "frame", "individual_a", "individual_b", turn.alias("angle"))
