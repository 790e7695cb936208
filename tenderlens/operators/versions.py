"""Which version of a dossier counts: earliest, latest, or all before a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _extreme(notices: DataFrame, pick, bound) -> DataFrame:
    """One version per dossier. The instant is an aggregate of its own, so callers that need no other column carry none."""
    others = [c for c in notices.columns if c not in ("entry_id", "entry_updated")]
    rows = notices.groupBy("entry_id").agg(bound("entry_updated").alias("entry_updated"), pick(F.struct(*others), F.struct("entry_updated", "tie")).alias("v"))
    return rows.select(*(F.col(f"v.{c}") if c in others else F.col(c) for c in notices.columns))


def latest_versions(notices: DataFrame) -> DataFrame:
    """The newest version of every dossier; equal instants by `tie`. One shuffle; rows with strings are aggregated by sorting."""
    return _extreme(notices, F.max_by, F.max)


def as_published(notices: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The earliest version of every dossier first published in [first, last). Later versions cannot be such and go before they are shuffled."""
    rows = _extreme(notices if last is None else versions_until(notices, last), F.min_by, F.min)
    return rows.where(F.col("entry_updated") >= F.lit(first).cast("timestamp")) if first is not None else rows


def versions_until(notices: DataFrame, cutoff: str) -> DataFrame:
    return notices.where(F.col("entry_updated") < F.lit(cutoff).cast("timestamp"))


def current_with_tombstones(notices: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Latest versions with `withdrawn`: a tombstone wins whenever it came."""
    gone = tombstones.select("entry_id").distinct().withColumn("__gone", F.lit(True))
    return latest_versions(notices).join(gone, "entry_id", "left").withColumn("withdrawn", F.col("__gone").isNotNull()).drop("__gone")


def latest_metrics(results: DataFrame) -> DataFrame:
    """The newest row of each (metric, variant, alias); a null alias is one group."""
    w = Window.partitionBy("metric", "variant", "alias").orderBy(F.desc("computed_at"), F.desc("value"))
    return results.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def month_range(first: Column, last: Column) -> Column:
    """Months from first to last as YYYY-MM; raises where the range is reversed."""
    return F.transform(
        F.when(
            first <= last,
            F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")),
        ).otherwise(F.raise_error(F.lit("the first month is after the last")).cast("array<date>")),
        lambda d: F.date_format(d, "yyyy-MM"),
    )


def missing_months(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    return wanted.select("month").join(loaded.select("month"), "month", "left_anti")
