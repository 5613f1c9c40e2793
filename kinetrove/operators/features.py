"""Frame, clip, individual and window feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, inside
from ..sources.scratch import stored
from .events import directed_mouthing, double_occupancy, mouthing, spawning
from .intervals import marked
from .pairs import ordered_pairs
from .presence import in_roi, nfish_frame, nfish_pipe, seen
from .sequences import windowed

EVENTS = ["mouthing_event_id", "double_occupancy_event_id", "spawning_event_id"]


def frame_facts(pose: DataFrame, roi: DataFrame, near: tuple[str, str] = ("nose", "stripe4"), bodypart: str = "stripe1") -> DataFrame:
    """(clip, frame, nfish_frame, nfish_pipe, min_dist) of every frame, as ``nfish_frame``, ``nfish_pipe`` and ``min_distance`` give them, in one reading of the pose.

    A fish's points of interest become one row, a frame's fish one array; pairs are formed in place. Of a point that is there twice the larger coordinates count.
    """
    at = lambda part, c: F.max(F.when(F.col("bodypart") == part, F.col(c)))
    point = lambda part: F.struct(at(part, "x").alias("x"), at(part, "y").alias("y"))
    fish = pose.groupBy("clip", "frame", "individual").agg(F.bool_or(seen()).alias("here"), point(near[0]).alias("a"), point(near[1]).alias("b"), point(bodypart).alias("c"))
    fish = fish.join(roi.select("clip", "roi_x", "roi_y", "roi_r"), "clip", "left")
    held = inside(distance(F.col("c.x") - F.col("roi_x"), F.col("c.y") - F.col("roi_y")), "roi_r", True)
    rows = fish.groupBy("clip", "frame").agg(F.count_if("here").alias("nfish_frame"), F.count_if(held).alias("_n"), F.max("roi_r").alias("_r"), F.collect_list(F.struct("individual", "a", "b")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda p: F.transform(F.filter("f", lambda q: q["individual"] != p["individual"]), lambda q: distance(p["a"]["x"] - q["b"]["x"], p["a"]["y"] - q["b"]["y"]))))
    return rows.select("clip", "frame", "nfish_frame", F.when(F.col("_r").isNotNull(), F.col("_n")).alias("nfish_pipe"), F.array_min(pairs).alias("min_dist"))


def frame_features(pose: DataFrame, roi: DataFrame, quivering: DataFrame | None = None) -> DataFrame:
    """One row a frame: counts, event ids and the annotation flag.

    Frames that only the annotations name are kept, with NULL features. What a frame shows is stored once and read by each kind of event.
    """
    facts = stored(frame_facts(pose, roi), "facts")
    on = ["clip", "frame"]
    out = facts.select(*on, "nfish_frame", "nfish_pipe")
    for part in (mouthing(pose, distances=facts), double_occupancy(pose, roi, counts=facts), spawning(pose, distances=facts)):
        out = out.join(part, on)
    return out.withColumn("quivering", F.lit(False)) if quivering is None else out.join(quivering, on, "full_outer")


def clip_features(features: DataFrame, roi: DataFrame, trial_frames: int | None = None) -> DataFrame:
    """One row a clip, by one aggregate over its frames.

    Fractions of events and annotations are of the clip's frames, or of ``trial_frames`` where annotations cover
    a whole trial (``schema.TRIAL_FRAMES``); occupancy is always of the frames that have a count.
    """
    rows = F.count(F.lit(1)) if trial_frames is None else F.lit(trial_frames)
    aggs = [F.try_divide(F.count_if("quivering").cast("double"), rows).alias("quivering_fraction")]
    for c in EVENTS:
        name = c.removesuffix("_event_id")
        aggs += [F.count_distinct(F.when(F.col(c) >= 0, F.col(c))).alias(f"n_{name}_events"), F.try_divide(F.count_if(F.col(c) >= 0).cast("double"), rows).alias(f"{name}_event_fraction")]
    aggs += [F.max("nfish_frame").alias("nfish_frame_max"), F.max("nfish_pipe").alias("nfish_pipe_max")]
    aggs += [F.try_divide(F.count_if(F.col("nfish_pipe") == k).cast("double"), F.count("nfish_pipe")).alias(f"raw_{w}_occupancy_fraction") for k, w in enumerate(("zero", "single", "double", "triple"))]
    return features.groupBy("clip").agg(*aggs).join(roi.select("clip", "roi_x", "roi_y", "roi_r"), "clip", "left")


def individual_features(pose: DataFrame, roi: DataFrame, cover: DataFrame | None = None, **mouth) -> DataFrame:
    """(clip, frame, individual, in_roi, mouther, mouthee, roi_occupancy, mouthing, quivering); the last three are frame-wide."""
    held = in_roi(pose, roi)
    total = held.groupBy("clip", "frame").agg(F.count_if("in_roi").alias("roi_occupancy"))
    out = held.join(directed_mouthing(pose, **mouth), ["clip", "frame", "individual"]).join(total, ["clip", "frame"])
    return out.withColumn("quivering", F.lit(False)) if cover is None else marked(out, cover, [c for c in cover.columns if c in ("clip", "frame")])


def window_features(pose: DataFrame, roi: DataFrame, length: int = 30, nothing: float = 1000.0) -> DataFrame:
    """(clip, start, stop, med_nfish, med_nfish_pipe, min_separation) of each whole fixed window."""
    on = ["clip", "frame"]
    stripes = ordered_pairs(pose, "stripe1", "stripe1").where("individual_a < individual_b").groupBy(*on).agg(F.min("dist").alias("sep"))
    rows = nfish_frame(pose).join(nfish_pipe(pose, roi), on).join(stripes, on, "left")
    rows = windowed(rows, length)
    out = rows.groupBy("clip", "window").agg(
        F.min("frame").alias("start"), F.max("frame").alias("stop"), F.median("nfish_frame").alias("med_nfish"),
        F.median("nfish_pipe").alias("med_nfish_pipe"), F.coalesce(F.min("sep"), F.lit(nothing)).alias("min_separation"),
    )
    return out.drop("window")


def window_speed(pose: DataFrame, length: int = 30, bodypart: str = "stripe1") -> DataFrame:
    """(clip, start, stop, mean_speed) of each whole fixed window: the mean step of all individuals' points from row to row inside it."""
    rows = windowed(pose.where(F.col("bodypart") == bodypart), length)
    step = Window.partitionBy("clip", "window", "individual").orderBy("frame")
    dx, dy = (F.col(c) - F.lag(c).over(step) for c in ("x", "y"))
    rows = rows.withColumn("speed", F.sqrt(dx * dx + dy * dy))
    return rows.groupBy("clip", "window").agg(F.min("frame").alias("start"), F.max("frame").alias("stop"), F.avg("speed").alias("mean_speed")).drop("window")
