"""Behavioural events: density clusters of frames that meet a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clock
from .pairs import min_distance, ordered_pairs
from .presence import frames, nfish_pipe
from .sequences import bounds, dbscan1d, labelled


def mouthing(pose: DataFrame, thresh: float = 25, eps: int = 15, min_samples: int = 15, filled: bool = True, distances: DataFrame | None = None) -> DataFrame:
    d = min_distance(pose) if distances is None else distances
    return labelled(d, F.col("min_dist") < thresh, ["clip"], eps, min_samples, "mouthing_event_id", filled)


def spawning(pose: DataFrame, thresh: float = 25, eps: int = 150, min_samples: int = 30, distances: DataFrame | None = None) -> DataFrame:
    d = min_distance(pose) if distances is None else distances
    return labelled(d, F.col("min_dist") < thresh, ["clip"], eps, min_samples, "spawning_event_id")


def double_occupancy(pose: DataFrame, roi: DataFrame, eps: int = 30, min_samples: int = 30, counts: DataFrame | None = None) -> DataFrame:
    n = nfish_pipe(pose, roi) if counts is None else counts
    return labelled(n, F.col("nfish_pipe") == 2, ["clip"], eps, min_samples, "double_occupancy_event_id")


def directed_mouthing(pose: DataFrame, thresh: float = 30, eps: int = 15, min_samples: int = 15) -> DataFrame:
    """(clip, frame, individual, mouther, mouthee, mouthing) for every individual of every frame.

    Each ordered pair is clustered by itself; its events' frames come from the bounds by an equi-join.
    """
    by = ["clip", "individual_a", "individual_b"]
    hits = ordered_pairs(pose, "nose", "stripe4").where(F.col("dist") < thresh).select(*by, "frame")
    spans = bounds(dbscan1d(hits, by, eps, min_samples), by, "label")
    held = spans.select("clip", "individual_a", "individual_b", F.explode(F.sequence("start", "stop")).alias("frame")).join(frames(pose), ["clip", "frame"], "left_semi")
    roles = held.select("clip", "frame", F.explode(F.array(F.struct(F.col("individual_a").alias("individual"), F.lit(True).alias("mouther")), F.struct(F.col("individual_b").alias("individual"), F.lit(False).alias("mouther")))).alias("r"))
    found = roles.groupBy("clip", "frame", F.col("r.individual").alias("individual")).agg(F.bool_or("r.mouther").alias("mouther"), F.bool_or(~F.col("r.mouther")).alias("mouthee"))
    busy = held.select("clip", "frame", F.lit(True).alias("mouthing")).distinct()
    base = pose.select("clip", "frame", "individual").distinct()
    out = base.join(found, ["clip", "frame", "individual"], "left").join(busy, ["clip", "frame"], "left")
    return out.na.fill(False, ["mouther", "mouthee", "mouthing"])


def summary(events: DataFrame, label: str, fps: int = 30) -> DataFrame:
    """(clip, event_id, start, stop) as clock times."""
    found = bounds(events, ["clip"], label)
    return found.select("clip", "event_id", clock(F.col("start") / fps).alias("start"), clock(F.col("stop") / fps).alias("stop"))


def clip_bounds(events: DataFrame, label: str) -> DataFrame:
    """(clip, event_id, start, stop) in frames: what a media writer would cut."""
    return bounds(events, ["clip"], label)
