"""Centroids, speeds, headings, rolling statistics and the ego frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, distance, heading, inside, polar, rotated


def centroids(pose: DataFrame, keep_empty: bool = True) -> DataFrame:
    """(clip, frame, individual, centroid_x, centroid_y): means of the visible points."""
    out = pose.groupBy("clip", "frame", "individual").agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    return out if keep_empty else out.where("centroid_x is not null and centroid_y is not null")


def roi_relations(cents: DataFrame, roi: DataFrame, inclusive: bool = True) -> DataFrame:
    """Adds dist_from_roi_center, angle_to_roi_center and is_inside_roi (0/1)."""
    at = cents.join(roi.select("clip", "roi_x", "roi_y", "roi_r"), "clip", "left")
    dx, dy = F.col("centroid_x") - F.col("roi_x"), F.col("centroid_y") - F.col("roi_y")
    out = at.withColumns({"dist_from_roi_center": distance(dx, dy), "angle_to_roi_center": angle(dy, dx)})
    held = F.coalesce(inside(F.col("dist_from_roi_center"), "roi_r", inclusive), F.lit(False)).cast("int")
    return out.withColumn("is_inside_roi", held).drop("roi_x", "roi_y", "roi_r")


def velocities(pose: DataFrame) -> DataFrame:
    """(clip, individual, bodypart, frame, speed, heading) from one table row to the next of a point.

    The heading's arguments stand in the order (dx, dy): degrees from the y axis.
    """
    w = Window.partitionBy("clip", "individual", "bodypart").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    moved = pose.select("clip", "individual", "bodypart", "frame", dx.alias("dx"), dy.alias("dy"))
    return moved.select("clip", "individual", "bodypart", "frame", distance(F.col("dx"), F.col("dy")).alias("speed"), angle(F.col("dx"), F.col("dy")).alias("heading"))


def _centred(size: int, by: list[str]):
    return Window.partitionBy(*by).orderBy("frame").rowsBetween(-(size // 2), size - 1 - size // 2)


def rolling(rows: DataFrame, value: str, by: list[str], size: int = 31) -> DataFrame:
    """Adds rollavg_ and rollstd_ (population) of ``value``: NULL unless all rows of the window have one."""
    w = _centred(size, by)
    whole = F.count(value).over(w) == size
    return rows.withColumns({f"rollavg_{value}": F.when(whole, F.avg(value).over(w)), f"rollstd_{value}": F.when(whole, F.stddev_pop(value).over(w))})


def rolling_circular(rows: DataFrame, value: str, by: list[str], size: int = 31) -> DataFrame:
    """Circular mean in [0, 360) and circular standard deviation in degrees, under the same rule."""
    w = _centred(size, by)
    s, c = (F.avg(f(F.radians(value))).over(w) for f in (F.sin, F.cos))
    whole = F.count(value).over(w) == size
    rows = rows.withColumns({"_s": F.when(whole, s), "_c": F.when(whole, c)})
    r = F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    r = F.when(r > 1, 1.0).otherwise(r)  # least() would turn a NULL into 1
    return rows.withColumns({f"rollavg_{value}": F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)), f"rollstd_{value}": F.degrees(F.sqrt(-2 * F.log(r)))}).drop("_s", "_c")


def kinetics(cents: DataFrame) -> DataFrame:
    """Adds centroid_speed, tangential and centripetal acceleration, over the rows that have a centroid.

    Differences run from row to row, so they cross gaps.
    """
    w = Window.partitionBy("clip", "individual").orderBy("frame")
    rows = cents.where("centroid_x is not null and centroid_y is not null")
    rows = rows.withColumns({f"_d{c}": F.col(f"centroid_{c}") - F.lag(f"centroid_{c}").over(w) for c in "xy"})
    rows = rows.withColumns({f"_a{c}": F.col(f"_d{c}") - F.lag(f"_d{c}").over(w) for c in "xy"})
    speed, turn = polar(F.col("_dx"), F.col("_dy"))
    acc, acc_turn = polar(F.col("_ax"), F.col("_ay"))
    theta = acc_turn - turn
    out = rows.withColumns({"centroid_speed": speed, "centroid_tangential_acceleration": acc * F.cos(theta), "centroid_centripetal_acceleration": acc * F.sin(theta)})
    return out.drop("_dx", "_dy", "_ax", "_ay")


def individual_kinematics(pose: DataFrame, roi: DataFrame) -> DataFrame:
    """The feature matrix of each individual: centroid, region (strict), kinetics and the number in its name."""
    rows = roi_relations(centroids(pose, keep_empty=False), roi, inclusive=False).drop("angle_to_roi_center")
    return kinetics(rows).withColumn("id_number", F.substring("individual", -1, 1).try_cast("int"))


def ego_frame(pose: DataFrame, roi: DataFrame, tail: list[str], origin: str = "stripe1", ahead: str = "nose") -> DataFrame:
    """(clip, frame, individual, bodypart, origin_x, origin_y, ego_x, ego_y).

    Points stand in a frame whose origin is ``origin`` and whose x axis points to ``ahead``; the origin itself
    is relative to the region's centre. Origin and axis are picked by an aggregate per fish and frame.
    """
    pick = lambda part, c: F.max(F.when(F.col("bodypart") == part, F.col(c)))
    fish = pose.where(F.col("bodypart").isin(origin, ahead)).groupBy("clip", "frame", "individual")
    base = fish.agg(pick(origin, "x").alias("ox"), pick(origin, "y").alias("oy"), pick(ahead, "x").alias("hx"), pick(ahead, "y").alias("hy"))
    rows = pose.where(F.col("bodypart").isin(tail)).join(base, ["clip", "frame", "individual"]).join(roi.select("clip", "roi_x", "roi_y"), "clip", "left")
    theta = heading(F.col("hx") - F.col("ox"), F.col("hy") - F.col("oy"))
    ex, ey = rotated(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), theta)
    return rows.select("clip", "frame", "individual", "bodypart", (F.col("ox") - F.col("roi_x")).alias("origin_x"), (F.col("oy") - F.col("roi_y")).alias("origin_y"), ex.alias("ego_x"), ey.alias("ego_y"))


def standard_scale(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0.

    Statistics come by one aggregate: of all rows as scalar subqueries, of groups by a join.
    """
    stats = [s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    if by:
        rows = rows.join(rows.groupBy(*by).agg(*stats), by)
    else:
        found = rows.agg(*stats)
        rows = rows.withColumns({c: found.select(c).scalar() for c in found.columns})
    scale: dict[str, Column] = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return rows.withColumns(scale).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])
