"""Runs of frames, one-dimensional density clusters, fills and fixed windows: all window functions.

Runs are numbered by segmented scans. Density clusters are labelled by ranges of ``CHUNK``
frames that overlap by what a frame's label can depend on, and fills meet frames by bins, so a clip of any length is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .overlaps import within
from .scans import CHUNK, running_sum


def islands(rows: DataFrame, by: list[str], order: str = "frame", name: str = "run", chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: equal for rows of consecutive ``order``, different across gaps. A row's ``order`` less its place in the group, counted range by range."""
    return running_sum(rows, by, F.lit(1), "_count", order, chunk).withColumn(name, F.col(order) - F.col("_count")).drop("_count")


def runs(rows: DataFrame, by: list[str], least: int = 1, order: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """(by..., start, stop, n): maximal runs of at least ``least`` rows, both ends inclusive."""
    found = islands(rows, by, order, chunk=chunk).groupBy(*by, "run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least).select(*by, "start", "stop", "n")


def dbscan1d(hits: DataFrame, by: list[str], eps: int, min_samples: int, order: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Adds ``label``: the density cluster of each row along ``order`` (whole numbers), -1 for noise, from 0 in order.

    A row is a core if at least ``min_samples`` rows, itself included, lie within eps of it; cores at most eps
    apart share a cluster; other rows take the cluster of the nearest core within eps, the earlier of two.

    Whether a row is a core, opens a cluster or has one near depends on rows up to 2 eps away. So ranges of ``chunk`` are labelled
    with copies of the rows around them, and a range's clusters are numbered on from those of the ranges before it.
    """
    chunk = max(chunk, 2 * eps + 1)
    here, own = F.col(order), F.col("_own")
    near = F.sequence(F.floor((here - 2 * eps) / chunk), F.floor((here + 2 * eps) / chunk))
    rows = hits.withColumn("_chunk", F.explode(near)).withColumn("_own", F.floor(here / chunk) == F.col("_chunk"))
    each = Window.partitionBy(*by, "_chunk")
    base = each.orderBy(order)
    until = base.rowsBetween(Window.unboundedPreceding, 0)
    # frames that start at the window's first row grow row by row; ones that end at its last would be summed up anew for each row
    since = each.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(base.rangeBetween(-eps, eps)))
    rows = rows.withColumn("_core", F.when(F.col("_n") >= min_samples, here))
    before = F.last("_core", ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before).withColumn("_after", F.last("_core", ignorenulls=True).over(since))
    opens = F.col("_core").isNotNull() & (F.col("_before").isNull() | (here - F.col("_before") > eps))
    rows = rows.withColumn("_opened", F.sum((opens & own).cast("bigint")).over(until))
    rows = rows.where(own)
    # one row a range
    opened = rows.groupBy(*by, "_chunk").agg(F.max("_opened").alias("_new"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select(*by, "_chunk", F.coalesce(F.sum("_new").over(earlier), F.lit(0)).alias("_earlier"))
    rows = rows.join(opened, [*by, "_chunk"])
    left, right = here - F.col("_before"), F.col("_after") - here
    next_opens = (F.col("_before").isNull() | (F.col("_after") - F.col("_before") > eps)).cast("bigint")
    so_far = F.col("_earlier") + F.col("_opened")
    label = (
        F.when(F.col("_core").isNotNull(), so_far - 1)
        .when((left <= eps) & (right.isNull() | (right > eps) | (left <= right)), so_far - 1)
        .when(right <= eps, so_far + next_opens - 1)
        .otherwise(F.lit(-1).cast("bigint"))
    )
    return rows.withColumn("label", label).select(*hits.columns, "label")


def fill(frames: DataFrame, by: list[str], label: str, order: str = "frame") -> DataFrame:
    """Frames between an event's first and last frame take its label; others have -1. Events do not overlap."""
    spans = frames.where(F.col(label) >= 0).groupBy(*by, F.col(label).alias("_e")).agg(F.min(order).alias("start"), F.max(order).alias("stop"))
    out = within(frames, spans, by, order, how="left").withColumn(label, F.coalesce("_e", F.lit(-1).cast("bigint")))
    return out.select(*frames.columns)


def labelled(frames: DataFrame, hit: Column, by: list[str], eps: int, min_samples: int, name: str, filled: bool = True) -> DataFrame:
    """(by..., frame, name) for every frame: the cluster of its hits, -1 elsewhere."""
    found = dbscan1d(frames.where(hit).select(*by, "frame"), by, eps, min_samples).withColumnRenamed("label", name)
    out = frames.select(*by, "frame").join(found, [*by, "frame"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1).cast("bigint")))
    return fill(out, by, name) if filled else out


def bounds(events: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by..., event_id, start, stop): first and last frame of each event."""
    return events.where(F.col(label) >= 0).groupBy(*by, F.col(label).alias("event_id")).agg(F.min("frame").alias("start"), F.max("frame").alias("stop"))


def windowed(frames: DataFrame, length: int, first: int = 0, drop_last_full: bool = False) -> DataFrame:
    """Adds ``window`` = frame div length and keeps windows that lie wholly inside a clip's frame range.

    ``drop_last_full`` also drops the last whole window of a clip.
    """
    span = frames.groupBy("clip").agg(F.min("frame").alias("_lo"), F.max("frame").alias("_hi"))
    rows = frames.join(span, "clip").withColumn("window", F.floor((F.col("frame") - first) / length))
    start = F.col("window") * length + first
    end = start + length - 1
    limit = F.col("_hi") - 1 if drop_last_full else F.col("_hi")
    return rows.where((start >= F.col("_lo")) & (end <= limit)).drop("_lo", "_hi")
