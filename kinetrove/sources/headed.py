"""CSV tables whose columns are named by several header lines: tracker output, error tables, collated sheets.

A header line has its level's name in the first cell and each column's name on that level in the others; such lines are told from rows by that name, so
it does not matter how a file is split. A file's columns become one array of names and places, which meets the file's lines by a join on the file; cells are then
picked by place within the line. Files may differ in their columns. Nothing is inferred or listed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .keys import bare, cells

TRACKER = ["scorer", "individuals", "bodyparts", "coords"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.where("value <> ''").withColumn("name", F.replace(F.substring_index("value", ",", 1), F.lit('"'), F.lit("")))


def _tree(lines: DataFrame, levels: list[str], index: int) -> DataFrame:
    """(path, place, levels...): each column's names; places count from 1."""
    heads = lines.where(F.col("name").isin(levels)).select("path", "name", F.posexplode(cells(F.col("value"))).alias("at", "cell")).where(F.col("at") >= index)
    return heads.groupBy("path", (F.col("at") + 1).alias("place")).agg(*[F.max(F.when(F.col("name") == x, F.col("cell"))).alias(x) for x in levels])


def read_headed(spark: SparkSession, path: str, levels: list[str], index: list[str]) -> DataFrame:
    """(path, index..., levels..., value) of every cell of the files below ``path``, melted: index cells as text, values as numbers, NULL where empty.

    ``levels`` are the names of the header lines; a line that begins with the first index name, where there is one, names the index and is no row.
    """
    lines = _lines(spark, path)
    columns = _tree(lines, levels, len(index)).groupBy("path").agg(F.collect_list(F.struct("place", *levels)).alias("columns"))
    rows = lines.where(~F.col("name").isin([*levels, index[0]])).select("path", cells(F.col("value")).alias("cells")).join(columns, "path")
    held = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(index)]
    melted = rows.select("path", *held, "cells", F.explode("columns").alias("c")).select("path", *index, "c.*", F.get("cells", F.col("c.place") - 1).try_cast("double").alias("value"))
    return melted.select("path", *index, *levels, schema.missing(F.col("value")).alias("value"))


def read_tracker(spark: SparkSession, path: str, likelihood: bool = False, individual: str = schema.INDIVIDUALS[0]) -> DataFrame:
    """Tracker files (scorer, individuals, bodyparts, coords) as long pose; files without a line of individuals have ``individual``.

    The clip is a ``clip=`` folder's, else the file's name before its model suffix. A line's coordinates are gathered in place: there is no shuffle but that of the
    join with the files' columns.
    """
    lines = _lines(spark, path)
    tree = _tree(lines, TRACKER, 1)
    place = lambda coord: F.max(F.when(F.col("coords") == coord, F.col("place"))).alias(coord)
    points = tree.groupBy("path", F.coalesce("individuals", F.lit(individual)).alias("individual"), F.col("bodyparts").alias("bodypart")).agg(place("x"), place("y"), place("likelihood"))
    points = points.groupBy("path").agg(F.collect_list(F.struct("individual", "bodypart", "x", "y", "likelihood")).alias("points"))
    rows = lines.where(~F.col("name").isin(TRACKER)).select("path", cells(F.col("value")).alias("cells")).join(points, "path")
    file = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_extract("path", "/clip=([^/]*)/", 1)
    clip = F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract(bare(file), r"^(.*?)(?:DLC_.*)?$", 1))
    number = lambda c: F.get("cells", F.col(f"p.{c}") - 1).try_cast("double").alias(c)
    pose = rows.select("path", "cells", F.explode("points").alias("p")).select(clip.alias("clip"), F.get("cells", F.lit(0)).try_cast("bigint").alias("frame"), "p.individual", "p.bodypart", number("x"), number("y"), *([number("likelihood")] if likelihood else []))
    return schema.normalise(pose)


def read_errors(spark: SparkSession, path: str, metric: str = "rmse") -> DataFrame:
    """(individual, bodypart, rmse) of an error table with header lines scorer, individuals, body_parts and metric, a row an image."""
    found = read_headed(spark, path, ["scorer", "individuals", "body_parts", "metric"], ["image"]).where(F.col("metric") == metric)
    return found.select(F.col("individuals").alias("individual"), F.col("body_parts").alias("bodypart"), F.col("value").alias("rmse"))


def read_collated(spark: SparkSession, path: str) -> DataFrame:
    """A collated sheet (header lines individuals, bodyparts, coords; index video_name, segment_id, frame) as (clip, segment_id, frame, individual, bodypart, x, y)."""
    found = read_headed(spark, path, ["individuals", "bodyparts", "coords"], ["video_name", "segment_id", "frame"])
    keys = [F.col("video_name").alias("clip"), F.col("segment_id").cast("bigint").alias("segment_id"), F.col("frame").cast("bigint").alias("frame"), F.col("individuals").alias("individual"), F.col("bodyparts").alias("bodypart")]
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("coords") == c, F.col("value"))).alias(c) for c in ("x", "y")])


def write_headed(rows: DataFrame, path: str, index: list[str], columns: list[tuple[str, ...]], levels: list[str], index_line: bool = False, by: str | None = None) -> None:
    """One row a line, below its header lines, a folder ``by=...`` for each value of ``by``, or one file of a summary without it.

    ``rows``: index..., v (an array of values in the order of ``columns``, names by level), and ``by``. Lines are sorted by the index within a file.
    """
    heads = [[name, *[""] * (len(index) - 1), *[c[i] for c in columns]] for i, name in enumerate(levels)] + [[*index, *[""] * len(columns)]] * index_line
    quoted = lambda c: f'"{c}"' if "," in c else c
    text = [",".join(map(quoted, h)) for h in heads]
    row = F.concat(F.array(*[F.col(c).cast("string") for c in index]), F.transform("v", lambda x: F.coalesce(x.cast("string"), F.lit(""))))
    order = [F.col(c).alias(f"_{i}") for i, c in enumerate(index)]
    kept = [by] if by else []
    lines = rows.select(*kept, F.lit(len(text)).alias("_rank"), *order, F.array_join(row, ",").alias("value"))
    files = rows.select(*kept).distinct() if by else rows.sparkSession.range(1).select()
    head = files.select(*kept, F.posexplode(F.array(*map(F.lit, text))).alias("_rank", "value")).select(*kept, "_rank", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"_{i}") for i, c in enumerate(index)], "value")
    both = head.unionByName(lines)
    both = both.repartition(by) if by else both.coalesce(1)
    both = both.sortWithinPartitions(*kept, "_rank", *[f"_{i}" for i in range(len(index))]).select(*kept, "value")
    (both.write.partitionBy(by) if by else both.write).text(path)


def write_tracker(pose: DataFrame, path: str, scorer: str = "model", individuals: list[str] | None = None) -> None:
    """A tracker file for each clip."""
    names = [(scorer, i, b, c) for i in individuals or schema.INDIVIDUALS for b in schema.BODYPARTS for c in ("x", "y", "likelihood")]
    values = [F.max(F.when((F.col("individual") == i) & (F.col("bodypart") == b), F.col(c))) for _, i, b, c in names]
    flat = pose.groupBy("clip", "frame").agg(*[v.alias(f"_{k}") for k, v in enumerate(values)])
    flat = flat.select("clip", "frame", F.array(*[F.col(f"_{k}") for k in range(len(names))]).alias("v"))
    write_headed(flat, path, ["frame"], names, TRACKER, by="clip")


def write_collated(rows: DataFrame, path: str, individuals: list[str] | None = None) -> None:
    """(clip, segment_id, frame, individual, bodypart, x, y) as a collated sheet, a file for each clip."""
    names = [(i, b, c) for i in individuals or schema.INDIVIDUALS for b in schema.BODYPARTS for c in ("x", "y")]
    values = [F.max(F.when((F.col("individual") == i) & (F.col("bodypart") == b), F.col(c))) for i, b, c in names]
    flat = rows.groupBy("clip", F.col("clip").alias("video_name"), "segment_id", "frame").agg(*[v.alias(f"_{k}") for k, v in enumerate(values)])
    flat = flat.select("clip", "video_name", "segment_id", "frame", F.array(*[F.col(f"_{k}") for k in range(len(names))]).alias("v"))
    write_headed(flat, path, ["video_name", "segment_id", "frame"], names, ["individuals", "bodyparts", "coords"], True, "clip")
