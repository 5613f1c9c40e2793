"""Reading and writing tables: pose, regions, annotations, features, summaries.

A keyed store is one Parquet table partitioned by clip: a keyed read is partition
pruning, a keyed append overwrites that clip's partition alone.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema
from .keys import bare, cells


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinetrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_pose(spark: SparkSession, path: str, likelihood: bool = False, form: str = "parquet") -> DataFrame:
    """The long pose table, with its declared schema; only the columns asked for are read."""
    reader = spark.read.schema(schema.POSE)
    pose = reader.csv(path, header=True, nanValue="NaN") if form == "csv" else reader.parquet(path)
    return schema.normalise(pose if likelihood else pose.drop("likelihood"))


def read_wide_pose(spark: SparkSession, path: str, clip: str | None = None, individuals: list[str] | None = None) -> DataFrame:
    """A flat table ``frame, <bodypart><id><x|y|c>`` (short names) as long pose; it is of one ``clip``, or has a column with it."""
    wide = spark.read.csv(path, header=True, inferSchema=False) if path.endswith(".csv") else spark.read.parquet(path)
    ids = individuals or schema.INDIVIDUALS
    points = [(i, b, f"{s}{i[-1]}") for i in ids for b, s in schema.BODYPARTS.items() if f"{s}{i[-1]}x" in wide.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("individual"), F.lit(b).alias("bodypart"), F.col(p + "x").cast("double").alias("x"), F.col(p + "y").cast("double").alias("y")) for i, b, p in points]))
    long = wide.select((F.col("clip") if clip is None else F.lit(clip)).alias("clip"), F.col("frame").cast("bigint").alias("frame"), rows.alias("p")).select("clip", "frame", "p.*")
    return schema.normalise(long)


def to_flat(pose: DataFrame, individuals: list[str] | None = None) -> DataFrame:
    """One row a frame with a column for each point and coordinate, named by short names."""
    aggs = []
    for i in individuals or schema.INDIVIDUALS:
        for b, s in schema.BODYPARTS.items():
            here = (F.col("individual") == i) & (F.col("bodypart") == b)
            aggs += [F.max(F.when(here, F.col(c))).alias(f"{s}{i[-1]}{c}") for c in ("x", "y")]
    return pose.groupBy("clip", "frame").agg(*aggs)


def collate(poses: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """All clips in one table, without frames that hold no data; the clip is the file name before its model suffix."""
    named = [p.withColumn("clip", F.lit(n)) if n else p for p, n in zip(poses, names or [None] * len(poses))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    rows = rows.withColumn("clip", F.regexp_extract("clip", r"^(.*?)(?:DLC_.*)?$", 1))
    held = rows.where("x is not null or y is not null").select("clip", "frame").distinct()
    return rows.join(held, ["clip", "frame"], "left_semi")


def keys(store: DataFrame) -> DataFrame:
    return store.select("clip").distinct()


def of_key(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("clip") == key.strip("/"))


def append(df: DataFrame, path: str) -> None:
    """Writes clips into the store; clips that are there already are replaced, others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("clip").parquet(path)


def read_roi(spark: SparkSession, path: str) -> DataFrame:
    roi = spark.read.csv(path, header=True)
    name = "video_key" if "video_key" in roi.columns else "clip"
    return roi.select(bare(F.col(name)).alias("clip"), *[F.col(f.name).cast(f.dataType) for f in schema.ROI.fields[1:] if f.name in roi.columns])


def read_annotations(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema.ANNOTATIONS)
    rows = reader.csv(path, header=True) if form == "csv" else reader.parquet(path)
    return schema.normalise(rows)


def read_features(spark: SparkSession, paths: str | list[str], fields: T.StructType) -> DataFrame:
    """Feature CSVs of many clips as one table, by column name, missing columns and empty cells NULL.

    Files may differ in their columns and in the order of them: each file's lines meet its first line by a join, and cells are picked by the names there. No
    file's name or line reaches the driver but by Spark's own listing. A line that repeats its file's first one is no row.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    first = lines.where("block = 0").withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "at").alias("head"))
    rows = lines.join(first, "path").where("value <> head").select(cells(F.col("head")).alias("names"), cells(F.col("value")).alias("cells"))
    cell = lambda name: F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)  # noqa: E731  past the end or before the start: NULL
    return rows.select(*[F.when(F.array_contains("names", f.name) & (cell(f.name) != ""), cell(f.name)).cast(f.dataType).alias(f.name) for f in fields.fields])


def write_csv(df: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """``single``: one file, for summaries, whose rows are few; an empty one still has its header."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", header).csv(path)


def read_kp_error(spark: SparkSession, path: str) -> DataFrame:
    return schema.normalise(spark.read.schema(schema.KP_ERROR).csv(path, header=True))


def discover(spark: SparkSession, parent: str, pattern: str) -> DataFrame:
    """Files below ``parent`` whose name matches ``pattern`` as a whole, sorted by path; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(parent).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(name.rlike(f"^(?:{pattern})$")).orderBy("path")


def first_match(files: DataFrame, stem: str, suffix: str) -> DataFrame:
    """The first file by path whose name starts with ``stem`` and ends with ``suffix``; no row if there is none."""
    return files.where(F.startswith("name", F.lit(stem)) & F.endswith("name", F.lit(suffix))).orderBy("path").limit(1)
