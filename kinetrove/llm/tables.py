"""Reading the inputs, scratch folders and row iteration shared by the operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a session with a local master, as in tests, gets a folder of this machine; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")

        root = "file://" + tempfile.mkdtemp(prefix="kinetrove-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    free(spark)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished steps; it acts on the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Removes the folders of ``stored`` tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def with_row_id(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """``rid`` and the named columns. rid is the key where that is a whole number that tells all rows apart, else a stored row number."""
    from pyspark.sql import functions as F

    ids = docs.agg(F.count(key).alias("some"), F.count(F.lit(1)).alias("all")).first()
    whole = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    repeated = ids["some"] == ids["all"] and docs.groupBy(key).count().where("count > 1").limit(1).count()
    kept = docs.select(*columns)
    if whole and ids["some"] == ids["all"] and not repeated:
        return kept.withColumn("rid", F.col(key).cast("long"))
    return stored(kept.withColumn("rid", F.monotonically_increasing_id()), "rows")


def sum_vectors(rows: DataFrame, blocks: int, width: int):
    """The sum of (block, salt, vector) rows as a ``blocks`` x ``width`` array of int64.

    Tasks emit their tables in blocks; sums go over (block, salt) first, so at most 64
    vectors a block meet in one task and what reaches the driver has a fixed size.
    """
    import numpy as np

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, "<i8")
                sums[block] = sums[block] + x if block in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["block", "vector"])

    schema = "block long, vector binary"
    first = rows.repartition("block", "salt").select("block", "vector").mapInArrow(add, schema)
    total = np.zeros((blocks, width), np.int64)
    for row in first.repartition("block").mapInArrow(add, schema).collect():
        total[row["block"]] += np.frombuffer(row["vector"], "<i8")
    return total


def loose(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its partitioning by these long columns forgotten.

    A join with an aggregate's result would reuse the aggregate's partitions, and then Spark
    can't split a hot key of the other side; dealt out anew for the join, it can.
    """
    from pyspark.sql import functions as F

    return df.withColumns({c: F.bitwise_not(F.bitwise_not(c)) for c in columns})


class BitFilter:
    """Which of a table's 64-bit hashes a value may be among: two bits a hash in a broadcast of ``bits`` bits, whatever the table's size.

    It never misses one; how many others it lets through depends on how full it is. Executors set the bits, and what
    reaches the driver are the filter's own words.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int):
        import numpy as np
        from pyspark.sql import functions as F

        self.bits = bits
        places = self._places

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits, bool)
            for batch in batches:
                for at in places(batch.column(0).to_numpy().view(np.uint64), bits):
                    own[at] = True
            words = np.packbits(own, bitorder="little").view("<i8")
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], ["at", "word"])

        words = hashes.select(column).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        out = np.zeros(bits // 64, "<i8")
        out[words.column("at").to_numpy()] = words.column("word").to_numpy()
        self.sent = hashes.sparkSession.sparkContext.broadcast(out.tobytes())

    @staticmethod
    def _places(hashes, bits: int) -> list:
        return [(hashes >> hashes.dtype.type(shift)) & hashes.dtype.type(bits - 1) for shift in (0, 32)]

    def holds(self):
        """A function on arrays of unsigned hashes, made once a task."""
        import numpy as np

        words = np.frombuffer(self.sent.value, np.uint8)

        def test(hashes):
            found = np.ones(len(hashes), bool)
            for at in self._places(hashes, self.bits):
                found &= (words[(at >> at.dtype.type(3)).astype(np.int64)] >> (at & at.dtype.type(7)).astype(np.uint8)) & 1 > 0
            return found

        return test
