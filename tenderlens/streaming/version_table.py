"""The stored versions in hash buckets, and beside them the first and last version of every dossier.

Both tables are Parquet folders partitioned by `bucket` (of the first key) and
`batch` (a tag of the caller's).  A batch reads only the buckets that its rows fall
into, and writes only its own partitions, which a second run of the same batch
overwrites: it leaves its own rows aside when it looks for known ones, so that a
crash at any point and a rerun end in the same table.

The state is a log.  A batch adds a row for each dossier whose first or last version
it moves, with the instants before; the state is the least first and the greatest
last of a dossier's rows, whatever their order and however often a row is there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

BUCKETS = 64
SLICES = 4  # a bucket of a batch is worked on by so many tasks at most, and has so many files


def batch_tag(stream: str, number: int) -> str:
    """The tag of a stream's batch: streams of other checkpoints have others."""
    return f"{hashlib.md5(stream.encode()).hexdigest()[:12]}-{number}"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table at path with its columns bucket and batch; None where nothing has been written yet."""
    whole = StructType([*schema.fields]).add("bucket", IntegerType()).add("batch", StringType())
    try:
        return spark.read.schema(whole).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def touched(rows: DataFrame) -> list[int]:
    """Buckets that rows fall into; there are no more than the table has."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def earlier(spark: SparkSession, path: str, schema: StructType, buckets: list[int], tag: str) -> DataFrame | None:
    """What other batches have stored in those buckets; the others are not read."""
    held = stored(spark, path, schema)
    return None if held is None else held.where(F.col("bucket").isin(buckets) & (F.col("batch") != tag))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by slices of their buckets: what has the same key stands together, and goes on to be compared, merged and written there."""
    slice_of = F.pmod(F.shiftright(F.xxhash64(F.col(key).cast("string")), 32), F.lit(SLICES)).cast("int")
    return rows.withColumn("__slice", slice_of).repartition("bucket", "__slice")


def write_batch(rows: DataFrame, path: str, tag: str) -> None:
    """A few files for each bucket of dealt() rows, in place of what a run of this batch left before."""
    out = rows.drop("__slice").withColumn("batch", F.lit(tag)).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def append_batch(batch: DataFrame, path: str, keys: list[str], tag: str, buckets: int = BUCKETS) -> DataFrame:
    """Stores the rows of batch whose keys no other batch has stored, each key once, and returns them.

    The rows and the keys stored before are dealt once; they are compared and written where they are then. Keys that hold a null
    are equal within a batch, but to none stored before.
    """
    spark, schema = batch.sparkSession, batch.schema
    rows = batch.withColumns({"bucket": bucket_of(keys[0], buckets), "__known": F.lit(False)})
    known = earlier(spark, path, schema, touched(rows), tag)
    if known is not None:
        rows = rows.unionByName(known.na.drop(subset=keys).select(*keys, "bucket", F.lit(True).alias("__known")), allowMissingColumns=True)
    same = Window.partitionBy("bucket", "__slice", *keys).orderBy(F.desc("__known"))
    first = dealt(rows, keys[0]).withColumn("__n", F.row_number().over(same)).where("__n = 1 and not __known")
    write_batch(first.drop("__n", "__known"), path, tag)
    return stored(spark, path, schema).where(F.col("batch") == tag).drop("bucket", "batch")


def _order(version: str, columns: list[str]) -> Column:
    """What versions are ordered by: the instant, then the tie where there is one."""
    return F.struct(*(F.col(f"{version}.{c}") for c in ("entry_updated", "tie") if c in columns))


def merged(rows: DataFrame) -> DataFrame:
    """(entry_id, first, last) of rows of that kind, any number for each dossier."""
    columns = rows.schema["first"].dataType.fieldNames()
    return rows.groupBy("entry_id").agg(F.min_by("first", _order("first", columns)).alias("first"), F.max_by("last", _order("last", columns)).alias("last"))


def update_state(versions: DataFrame, path: str, tag: str, buckets: int = BUCKETS) -> DataFrame:
    """Takes new versions into the state at path.

    Returns the changes: (entry_id, first, last, first_before, last_before), the instants null for dossiers not seen before.
    Versions and the log's rows are dealt once; they are merged, compared and written where they are then.
    """
    spark, columns = versions.sparkSession, [c for c in versions.columns if c != "entry_id"]
    rows = versions.select("entry_id", F.struct(*columns).alias("v"), bucket_of("entry_id", buckets).alias("bucket"))
    kind = rows.schema["v"].dataType
    schema = StructType([rows.schema["entry_id"]]).add("first", kind).add("last", kind).add("first_before", "timestamp").add("last_before", "timestamp")
    held = earlier(spark, path, schema, touched(rows), tag)
    none = F.lit(None).cast(kind)
    if held is None:
        both = rows.withColumns({"f": none, "l": none})
    else:
        both = rows.unionByName(held.select("entry_id", "bucket", F.col("first").alias("f"), F.col("last").alias("l")), allowMissingColumns=True)
    # a null has no place in the order: versions are compared with versions, and rows of the log with rows of the log
    given = lambda v: F.when(F.col(v).isNotNull(), _order(v, columns))
    ends = dealt(both, "entry_id").groupBy("bucket", "__slice", "entry_id").agg(
        F.min_by("v", given("v")).alias("first"),
        F.max_by("v", given("v")).alias("last"),
        F.min_by("f", given("f")).alias("f"),
        F.max_by("l", given("l")).alias("l"),
    )
    moved_first = F.col("f").isNull() | (_order("first", columns) < _order("f", columns))
    moved_last = F.col("l").isNull() | (_order("last", columns) > _order("l", columns))
    changes = ends.where(F.col("first").isNotNull() & (moved_first | moved_last)).select(
        "entry_id",
        F.when(moved_first, F.col("first")).otherwise(F.col("f")).alias("first"),
        F.when(moved_last, F.col("last")).otherwise(F.col("l")).alias("last"),
        F.col("f.entry_updated").alias("first_before"),
        F.col("l.entry_updated").alias("last_before"),
        "bucket",
    )
    write_batch(changes, path, tag)
    return stored(spark, path, schema).where(F.col("batch") == tag).drop("bucket", "batch")


def narrowed(schema: StructType, fields: list[str]) -> StructType:
    """The schema of update_state()'s result with no more than those fields of the versions."""
    kept = StructType([f for f in schema["first"].dataType.fields if f.name in fields])
    return StructType([schema["entry_id"]]).add("first", kept).add("last", kept)


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(entry_id, first, last) of all dossiers; schema is that of update_state()'s result, or what of it is asked for.

    A dossier has about a row a batch, so that rows are dealt as they are, without the instants that merging compares.
    """
    return merged(stored(spark, path, schema).select("entry_id", "first", "last").repartition("entry_id"))


def latest_of(state: DataFrame) -> DataFrame:
    """The newest version of every dossier, as latest_versions() finds it among all versions."""
    return state.select("entry_id", "last.*")


def published_of(state: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The earliest version of every dossier first published in [first, last), as as_published() finds it."""
    rows = state.select("entry_id", "first.*")
    if first is not None:
        rows = rows.where(F.col("entry_updated") >= F.lit(first).cast("timestamp"))
    return rows.where(F.col("entry_updated") < F.lit(last).cast("timestamp")) if last is not None else rows


def moved_out(changes: DataFrame, first: str, last: str) -> DataFrame:
    """(entry_id): dossiers that a batch's changes move out of the period in which they seemed first published."""
    inside = lambda c: (c >= F.lit(first).cast("timestamp")) & (c < F.lit(last).cast("timestamp"))
    return changes.where(inside(F.col("first_before")) & ~inside(F.col("first.entry_updated"))).select("entry_id")
