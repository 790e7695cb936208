"""Driving a stream over all that a source holds, and reading what it wrote."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; only local mode may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tenderlens-")  # one process is the whole cluster
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df from the shared folder: what its readers have in common is worked out once."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that run inside keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def replay_stages(rows: DataFrame, batch: Column, batches: int, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What make(stream of rows) emits, with the number of the batch, when rows arrive in that many batches.

    The stream is started anew from its checkpoint for every batch (rows by `batch`, from 0), as after a restart.
    """
    spark, at = rows.sparkSession, scratch(rows.sparkSession)
    numbered = rows.withColumn("__batch", batch)
    for i in range(batches):
        numbered.where(F.col("__batch") == i).drop("__batch").write.parquet(f"{at}/in/{i}")
        if i == 0:
            stream = make(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{at}/in"))
        drive(stream, mode, at)
    return spark.read.schema(stream.withColumn("batch", F.lit(0)).schema).parquet(f"{at}/out")


def drive(stream: DataFrame, mode: str, at: str) -> None:
    """Runs the stream over all that its source holds and appends what it emits to at/out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


