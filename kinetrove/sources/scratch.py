"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .stores import work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: later steps start from files, not from its plan, and lost executors cost no more than their tasks."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes the folders of ``stored`` tables that no later step reads."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def each_row(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a record batch as dicts, one at a time: rows may hold long arrays."""
    for at in range(batch.num_rows):
        yield batch.slice(at, 1).to_pylist()[0]
