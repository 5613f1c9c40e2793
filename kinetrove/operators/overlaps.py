"""Overlapping intervals by bins: equi-joins in place of range joins and of intervals spelt out row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / width)


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: float) -> DataFrame:
    """Pairs of rows whose closed intervals overlap, each pair once.

    ``left``: by..., lo, hi and others; ``right``: by..., start, stop and others. An interval is in every bin of ``width`` it touches, so the rows formed are
    the intervals times their bins; a pair counts in the first bin that both are in. A null end overlaps nothing.
    """
    a = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col("lo"), width), _bin(F.greatest("lo", "hi"), width)))).where("lo <= hi")
    b = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start"), width), _bin(F.greatest("start", "stop"), width)))).where("start <= stop")
    pairs = a.join(b, [*by, "_bin"]).where("lo <= stop and start <= hi")
    return pairs.where(F.col("_bin") == _bin(F.greatest("lo", "start"), width)).drop("_bin")


def within(rows: DataFrame, intervals: DataFrame, by: list[str], at: str = "frame", width: int = 256, how: str = "inner") -> DataFrame:
    """``rows`` with the intervals (by..., start, stop, ...) that hold their ``at``, both ends included; a row is in one bin and so never copied by the join's keys.

    ``how``: inner, left (rows in none stay, with nulls) or left_semi (rows in any, each once).
    """
    a = rows.withColumn("_bin", _bin(F.col(at), width))
    b = intervals.where("start <= stop").withColumn("_bin", F.explode(F.sequence(_bin(F.col("start"), width), _bin(F.greatest("start", "stop"), width))))
    keys = [*by, "_bin"]
    b = b.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in b.columns])
    on = [F.col(c) == F.col(f"_{c}") for c in keys] + [F.col(at) >= F.col("start"), F.col(at) <= F.col("stop")]
    out = a.join(b, on, how)
    return out.drop(*["_bin", "__bin", *[f"_{c}" for c in by]])
