"""What all operators need from the session: shared storage to cut lineage, and checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share; only local mode may do without that setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tenderlens-")  # one process is the whole cluster
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Tables written by this process and not discarded yet, oldest first.
_tables: list[str] = []


def written_at(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """df, written once as Parquet into the shared folder and read back, and where; shuffle files that led to it may go."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/tenderlens-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    del df
    _tables.append(path)
    drop_shuffles(spark)
    return spark.read.schema(schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """written_at(make()); all tables that were written on the way to it are discarded then."""
    before = len(_tables)
    out, path = written_at(make())
    for other in _tables[before:]:
        if other != path:
            discard(spark, other)
    return out, path


def discard(spark: SparkSession, path: str) -> None:
    """Empties a table of written_at() whose every reader has been written itself."""
    spark.range(0).write.mode("overwrite").parquet(path)
    if path in _tables:
        _tables.remove(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the files of shuffles that no live DataFrame refers to; it acts on the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint; for tables far smaller than the input."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df: then Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
