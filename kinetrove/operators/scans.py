"""Running counts, sums and previous rows along groups of any length: segmented scans with a carry.

A group is cut into ranges of its order. Each range is scanned by itself; its summary, one row, is scanned along the group's ranges; and what came before a range
is added to its rows by a join. So no task sorts more than a range of rows, however long a clip is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def _ranged(rows: DataFrame, order: str, chunk: int) -> DataFrame:
    return rows.withColumn("_range", F.floor(F.col(order) / chunk))


def running_sum(rows: DataFrame, by: list[str], value: Column, name: str, order: str = "frame", chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the group's rows up to each row by ``order``, which tells a group's rows apart."""
    rows = _ranged(rows, order, chunk).withColumn("_v", value)
    each = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_range").agg(F.sum("_v").alias("_all"))
    sums = sums.select(*by, "_range", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    out = rows.withColumn("_own", F.sum("_v").over(each)).join(sums, [*by, "_range"])
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_v", "_own", "_before")


def previous(rows: DataFrame, by: list[str], columns: list[str], order: str = "frame", chunk: int = CHUNK, prefix: str = "previous_") -> DataFrame:
    """Adds each of ``columns`` of the row before by ``order``, NULL in a group's first row."""
    rows = _ranged(rows, order, chunk)
    each = Window.partitionBy(*by, "_range").orderBy(order)
    along = Window.partitionBy(*by).orderBy("_range")
    held = F.struct(*columns)
    last = rows.groupBy(*by, "_range").agg(F.max_by(held, order).alias("_last"))
    last = last.select(*by, "_range", F.lag("_last").over(along).alias("_carry"))
    out = rows.withColumns({"_held": F.lag(held).over(each), "_place": F.row_number().over(each)}).join(last, [*by, "_range"])
    before = F.when(F.col("_place") == 1, F.col("_carry")).otherwise(F.col("_held"))
    out = out.withColumn("_held", before)
    return out.withColumns({prefix + c: F.col(f"_held.{c}") for c in columns}).drop("_range", "_held", "_place", "_carry")
