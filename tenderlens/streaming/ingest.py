"""The notice feed as a stream: ingest, deduplication, current state, cursor, spend.

Batches are merged by key in foreachBatch into tables in hash buckets (version_table.py),
so a batch that runs again after a restart adds nothing.  Late versions are stored whatever their date: no
watermark drops rows on the way to the version table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampType

from ..functions.text import madrid_day
from ..operators.silver import parse_notices, quarantine_split
from ..sources.feed import entries_of
from .version_table import BUCKETS, append_batch, batch_tag, update_state

KEYS = ["entry_id", "entry_updated"]


def feed_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(file, body) of every page file that arrives in the folder or below it."""
    options = {"wholetext": True, "maxFilesPerTrigger": files_per_batch, "recursiveFileLookup": True}
    return spark.readStream.format("text").options(**options).load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def ingest_stream(spark: SparkSession, folder: str, silver: str, quarantine: str, checkpoint: str, files_per_batch: int = 1000, state: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Pages to versions and quarantined entries, each version once across restarts; with `state`, first and last versions are kept there too."""

    def merge(pages: DataFrame, number: int) -> None:
        tag = batch_tag(checkpoint, number)
        parsed = parse_notices(entries_of(pages)).persist(StorageLevel.DISK_ONLY)  # parsed once for both tables, and no memory is held by it
        try:
            good, bad = quarantine_split(parsed)
            fresh = append_batch(good.drop("xml"), silver, KEYS, tag, buckets)
            if state is not None:
                update_state(fresh, state, tag, buckets)
            append_batch(bad, quarantine, ["file", "position"], tag, buckets)
        finally:
            parsed.unpersist()

    return feed_stream(spark, folder, files_per_batch).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_versions(stream: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Each version once within the lateness; beyond it append_batch() still refuses a second copy."""
    return stream.withWatermark("entry_updated", lateness).dropDuplicatesWithinWatermark(KEYS)


CURRENT = StructType([
    StructField("entry_id", StringType()),
    StructField("entry_updated", TimestampType()),
    StructField("state", StringType()),
    StructField("withdrawn", BooleanType()),
])
HELD = StructType([StructField("entry_updated", TimestampType()), StructField("state", StringType()), StructField("withdrawn", BooleanType())])


class CurrentState(StatefulProcessor):
    """Per dossier the newest version seen and whether a tombstone ever came, in whatever order they arrive; of versions of one instant the last by state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("current", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        updated, state, gone = self.held.get() if self.held.exists() else (None, None, False)
        for part in rows:
            gone = bool(gone or part["tombstone"].any())
            versions = part[~part["tombstone"]].sort_values(["entry_updated", "state"])
            if len(versions):
                last = versions.iloc[-1]
                if updated is None or (last["entry_updated"], last["state"]) > (pd.Timestamp(updated), state):
                    updated, state = last["entry_updated"].to_pydatetime(), last["state"]
        self.held.update((updated, state, gone))
        yield pd.DataFrame({
            "entry_id": [key[0]],
            "entry_updated": [pd.Timestamp(updated) if updated is not None else pd.NaT],
            "state": [state],
            "withdrawn": [gone],
        })

    def close(self) -> None:
        pass


def current_state_stream(changes: DataFrame) -> DataFrame:
    """Of a stream (entry_id, entry_updated, state, tombstone): the dossier's state after each batch that touches it.

    What CurrentState keeps of a dossier is a maximum and a flag, so Spark's own aggregates hold it and no row goes to Python.
    """
    version = F.when(~F.col("tombstone"), F.struct("entry_updated", "state"))
    held = changes.groupBy("entry_id").agg(F.max(version).alias("v"), F.coalesce(F.bool_or("tombstone"), F.lit(False)).alias("withdrawn"))
    return held.select("entry_id", "v.entry_updated", "v.state", "withdrawn")


def advance_cursor(read: DataFrame, cursor: DataFrame, complete: bool) -> DataFrame:
    """(cursor, warning) after one pass over entries read (entry_updated): the newest instant when complete; else the oldest read if there was none, or unchanged with a warning."""
    span = read.where("entry_updated is not null").agg(F.min("entry_updated").alias("oldest"), F.max("entry_updated").alias("newest"))
    rows = span.join(F.broadcast(cursor.agg(F.max("cursor").alias("before"))))
    if complete:
        return rows.select(F.greatest("before", "newest").alias("cursor"), F.lit(False).alias("warning"))
    return rows.select(F.coalesce("before", "oldest").alias("cursor"), F.col("before").isNotNull().alias("warning"))


def late_versions(batch: DataFrame, silver: DataFrame) -> DataFrame:
    """Versions of a batch that are older than what is stored of their dossier; they are kept, and may move its first publication."""
    newest = silver.groupBy("entry_id").agg(F.max("entry_updated").alias("newest"))
    return batch.join(newest, "entry_id").where("entry_updated < newest")


def spend_stream(calls: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Running calls and cost per company and Madrid day of a stream (alias, called_at, cost)."""
    return calls.withWatermark("called_at", lateness).groupBy("alias", madrid_day(F.col("called_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("cost").alias("cost"),
    )


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Drives a stream over all that is there and waits."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
