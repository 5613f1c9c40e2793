"""Exact quantiles of groups of any size, by histograms that close in on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import discard, stored

#: Cells of a histogram, and the values among which a rank is looked up directly.
CELLS, FEW = 256, 1024


def _closer(rows: DataFrame, goals: DataFrame, by: list[str], even: bool) -> DataFrame:
    """Goals (by..., rank, lo, hi, before, inside) with the one cell of their stretch that holds the rank, its ends drawn in to its own values.

    Cells are of equal width (``even``), or of equal width in the logarithm of the size, which closes in on values of very different sizes.
    """
    stretch = [*by, "lo", "hi"]
    # halves, so that no difference overflows; logarithms moved up, so that both signs keep their order
    scale = lambda c: F.col(c) / 2 if even else F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log2(F.abs(c)) + 1100))
    share = F.coalesce(F.try_divide(scale("x") - scale("lo"), scale("hi") - scale("lo")), F.lit(0.0))
    held = rows.join(goals.select(*stretch).distinct(), by).where("x >= lo and x <= hi").withColumn("cell", F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
    cells = held.groupBy(*stretch, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    upto = F.sum("n").over(Window.partitionBy(*stretch).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    met = goals.join(cells.withColumn("upto", upto), stretch).where("rank >= before + upto - n and rank < before + upto")
    return met.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"), F.col("n").alias("inside"))


def group_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], names: list[str], few: int = FEW) -> DataFrame:
    """(by..., n, names...): the number of values of each group and its quantiles, linear between neighbouring values; NULLs do not count.

    Each rank that is asked for has a stretch of values; a pass counts ``CELLS`` cells of every stretch at once, for all groups, with sums made before the
    shuffle, and keeps the cell that holds the rank, until it holds one value or at most ``few``. Passes take cells by value and by size in turn. So no task holds a group, nor its different values.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("x")).where("x is not null")
    facts = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "quantiles")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.explode(F.array_distinct(F.array(*[r(place(p)).cast("long") for p in shares for r in (F.floor, F.ceil)]))).alias("rank")
    goals = stored(facts.select(*by, ranks, "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "ranks")
    even = True
    while True:
        far = goals.where((F.col("lo") < F.col("hi")) & (F.col("inside") > few))
        if far.isEmpty():
            break
        near = goals.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= few))
        after = stored(near.unionByName(_closer(rows, far, by, even)), "ranks")
        even = not even
        discard(goals)
        goals = after
    stretch = [*by, "lo", "hi"]
    lists = rows.join(goals.where("lo < hi").select(*stretch).distinct(), by).where("x >= lo and x <= hi").groupBy(*stretch).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    found = goals.join(lists, stretch, "left").select(*by, "rank", F.coalesce(F.get("xs", (F.col("rank") - F.col("before")).cast("int")), F.col("lo")).alias("at"))
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("m"))  # a few ranks a group
    out = facts.join(found, by)

    def between(p: float):
        lower, upper = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.col("m")[lower], F.col("m")[upper]
        return F.when(lower == upper, a).otherwise((upper - place(p)) * a + (place(p) - lower) * b)

    return out.select(*by, "n", *[between(p).alias(name) for p, name in zip(shares, names)])
