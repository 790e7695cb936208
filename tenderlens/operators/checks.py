"""Quality checks: jobs that return the rows which break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import as_published


def duplicate_versions(notices: DataFrame) -> DataFrame:
    """Versions stored more than once."""
    return notices.groupBy("entry_id", "entry_updated").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def unknown_aliases(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Aliases that belong to nobody."""
    return rows.select("alias").distinct().join(companies.select("alias"), "alias", "left_anti")


def shared_aliases(study: DataFrame, clients: DataFrame) -> DataFrame:
    return study.select("alias").intersect(clients.select("alias"))


def changed_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles whose text is not the one that was frozen."""
    return profiles.where(~F.sha2("text", 256).eqNullSafe(F.col("sha256")))


def stale_runs(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Runs still open after that long."""
    return runs.where(F.col("ended_at").isNull() & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours))))


def close_stale(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    late = F.col("ended_at").isNull() & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours)))
    return runs.withColumns({"state": F.when(late, "error").otherwise(F.col("state")), "ended_at": F.when(late, now).otherwise(F.col("ended_at"))})


def universe_drift(universe: DataFrame, published: DataFrame) -> DataFrame:
    """The universe now against the size the newest published volume was computed on; a row only if they differ."""
    return universe.join(F.broadcast(published.select(F.col("n").alias("published")))).where("dossiers <> published").select("dossiers", "published")


def rule_drift(frozen: DataFrame, current: str) -> DataFrame:
    return frozen.where(~F.col("rule_sha").eqNullSafe(F.lit(current)))


def backfill_effect(before: DataFrame, after: DataFrame, first: str, last: str) -> DataFrame:
    """Dossiers in the period's universe that leave it once earlier versions are loaded."""
    return as_published(before, first, last).select("entry_id").exceptAll(as_published(after, first, last).select("entry_id"))
