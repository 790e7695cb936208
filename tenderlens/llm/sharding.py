"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; the
fractional rank (rank - 1/2) / rows of the source spreads every source evenly
over (0, 1); rows in that order are cut into runs whose lengths differ by one
at most, so that each shard has every source in proportion.

Neither ranking sorts a source, or the table, in one task: rows are dealt into
buckets that follow the order, buckets are counted, running sums over the
bucket counts give each bucket's first rank, and rows are numbered within their
bucket.  Buckets hold about sqrt(rows) rows, so bucket counts stay as small.

Defined results: a null source is a source of its own; null or empty texts are
rows like others (size 16, crc32 0); repeated rows are rows of their own, in
any order among themselves; an empty table gives an empty result; very long texts
only count by size.  Docs' columns named size, text_crc32, shard and slot are
replaced, others are kept; working columns start with `__shard_` and may not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import broadcast_within, checkpointed
from .mixing import MAX_BROADCAST_SOURCES

MAX_BROADCAST_BUCKETS = 100_000


def payload_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _numbered(rows: DataFrame, group: list[str], order: list, first: str) -> DataFrame:
    """rows with a 0-based rank per group: `__shard_bucket` follows `order`, and buckets' first ranks are running sums."""
    counts = rows.groupBy(*group, "__shard_bucket").agg(F.count(F.lit(1)).alias("__shard_n"))
    before = Window.partitionBy(*group).orderBy("__shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpointed(counts.withColumn("__shard_first", F.coalesce(F.sum("__shard_n").over(before), F.lit(0))))
    keys = [*group, "__shard_bucket"]
    firsts = counts.select(*(F.col(c).alias(f"{c}__k") for c in keys), "__shard_first")
    joined = rows.join(broadcast_within(firsts, MAX_BROADCAST_BUCKETS), [rows[c].eqNullSafe(F.col(f"{c}__k")) for c in keys]).drop(*(f"{c}__k" for c in keys))
    within = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn(first, F.col("__shard_first") + F.row_number().over(within) - 1).drop("__shard_bucket", "__shard_first")


def assign_shards(docs: DataFrame, shards: int = 40, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 42, least_bucket: int = 1024, measured: tuple[str, str] | None = None) -> DataFrame:
    """docs with `size`, `text_crc32`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard).

    measured names columns that already hold size and checksum, so that texts need not be shuffled.
    """
    rows = docs.drop("size", "text_crc32", "shard", "slot").withColumns({
        "size": F.col(measured[0]),
        "text_crc32": F.col(measured[1]),
    } if measured else {"size": payload_size(text), "text_crc32": text_crc32(text)})
    rows = rows.withColumn("__shard_hash", F.xxhash64(F.lit(seed), F.col(id_col).cast("string")))
    rows = rows.withColumn("__shard_source", F.col(source))
    strata = checkpointed(docs.groupBy(F.col(source).alias("__shard_key")).agg(F.count(F.lit(1)).alias("__shard_rows")))
    total = strata.agg(F.sum("__shard_rows")).first()[0] or 0
    bucket = max(least_bucket, int(total**0.5))
    rows = rows.join(broadcast_within(strata, MAX_BROADCAST_SOURCES), F.col("__shard_source").eqNullSafe(F.col("__shard_key"))).drop("__shard_key")
    unit = (F.shiftrightunsigned(F.col("__shard_hash").bitwiseXOR(F.lit(-(2**63))), 11)).cast("double") / float(2**53)
    # rows without an id have one hash: the order puts their checksums next, so do the buckets
    parts, lone = F.ceil(F.col("__shard_rows") / bucket), F.xxhash64(F.lit(seed), F.lit(None).cast("string"))
    within = F.when(F.col("__shard_hash") < lone, 0).when((F.col("__shard_hash") > lone) | F.col(id_col).isNotNull(), parts + 1).otherwise(1 + F.floor(F.col("text_crc32") / float(2**32) * parts))
    rows = rows.withColumn("__shard_bucket", F.floor(unit * parts) * (parts + 2) + within)
    ties = ["__shard_hash", id_col, "text_crc32", "size"]
    rows = _numbered(rows, ["__shard_source"], ties, "__shard_rank")
    fraction = (2 * F.col("__shard_rank") + 1) / (2.0 * F.col("__shard_rows"))
    rows = rows.withColumn("__shard_fraction", fraction)
    rows = rows.withColumn("__shard_bucket", F.floor(F.col("__shard_fraction") * max(1, -(-total // bucket))))
    rows = _numbered(rows, [], ["__shard_fraction", "__shard_source", *ties], "__shard_position")
    # integer division keeps the cut exact at any row count
    shard = F.expr(f"((__shard_position + 1) * {shards} - 1) div {max(total, 1)}")
    rows = rows.withColumn("shard", shard.cast("int"))
    rows = rows.withColumn("slot", F.expr(f"__shard_position - (shard * {total}L) div {shards}"))
    return rows.drop(*(c for c in rows.columns if c.startswith("__shard_")))
