"""Kernel density curves of groups of any size, by bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins a bandwidth, and the bandwidths after which a kernel is nothing in double precision's first nine digits.
BINS, REACH = 32, 7


def density_curves(rows: DataFrame, by: list[str], value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """(by..., point, at, density): the Gaussian kernel density of each group at ``points`` places from ``cut`` bandwidths below its least value to as many above its largest.

    The bandwidth is the sample deviation times n ** (-1 / 5); groups of fewer than two different values have no curve, and NULLs do not count.
    A group is a sparse histogram first, of ``BINS`` bins a bandwidth, each with its count, mean and variance; a bin stands for its values to the third order, and is sent to
    the points within ``REACH`` bandwidths alone. So what is formed are bins times points, whatever the number of rows.
    """
    x = F.col(value).cast("double")
    rows = rows.where(F.col(value).isNotNull()).select(*by, x.alias("x"))
    facts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("s > 0")
    facts = facts.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    facts = facts.select(*by, "n", "h", "lo", (F.col("lo") - cut * F.col("h")).alias("first"), ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)).alias("step"))
    bins = rows.join(facts, by).groupBy(*by, "n", "h", "first", "step", F.floor((F.col("x") - F.col("lo")) / F.col("h") * BINS).alias("bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    near = lambda sign: (F.col("m") + sign * REACH * F.col("h") - F.col("first")) / F.col("step")
    lo, hi = F.greatest(F.ceil(near(-1)), F.lit(0)), F.least(F.floor(near(1)), F.lit(points - 1))
    bins = bins.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").select("*", F.explode(F.sequence("_lo", "_hi")).alias("point"))
    at = F.col("first") + F.col("point") * F.col("step")
    u = (at - F.col("m")) / F.col("h")
    kernel = F.exp(-u * u / 2) * (1 + (u * u - 1) * F.col("v") / (2 * F.col("h") * F.col("h")))
    sums = bins.select(*by, "point", (F.col("k") * kernel).alias("w")).groupBy(*by, "point").agg(F.sum("w").alias("w"))
    every = facts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("point"))
    out = every.join(sums, [*by, "point"], "left")
    return out.select(*by, F.col("point").cast("int").alias("point"), at.alias("at"), (F.coalesce("w", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
