"""Writing policies over plain Parquet: append results, upserts, document outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .manifest import newest


def results_to_write(metrics: DataFrame, commit: str, command: str, run_id: str) -> DataFrame:
    """Metric rows with where they come from; rows without a value are not written."""
    return metrics.where(F.col("value").isNotNull()).withColumns({"commit": F.lit(commit), "command": F.lit(command), "run_id": F.lit(run_id)})


def write_results(metrics: DataFrame, path: str, commit: str, command: str, run_id: str) -> None:
    results_to_write(metrics, commit, command, run_id).write.mode("append").parquet(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], mode: str, order: list[Column] | None = None) -> DataFrame:
    """The table after source has been merged, with `action` (keep, insert, update).

    mode `ignore`: known keys stay as they are; `replace`: source wins.  Rows of
    source that share a key count once, the first by order (default: any order
    of all columns, so that the choice is stable).
    """
    once = newest(source, keys, order or [F.col(c) for c in source.columns])
    known = target.select(*keys).distinct().withColumn("__known", F.lit(True))
    marked = once.join(known, keys, "left")
    new = marked.where("__known is null").drop("__known").withColumn("action", F.lit("insert"))
    if mode == "ignore":
        return target.withColumn("action", F.lit("keep")).unionByName(new)
    if mode != "replace":
        raise ValueError(f"unknown upsert mode {mode!r}")
    changed = marked.where("__known").drop("__known").withColumn("action", F.lit("update"))
    untouched = target.join(once.select(*keys), keys, "left_anti").withColumn("action", F.lit("keep"))
    return untouched.unionByName(changed).unionByName(new)


def apply_outcomes(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents after a download pass: a readable file is descargado, an unreadable one ilegible and kept, a failure error and queued again."""
    o = outcomes.select(
        "doc_id",
        F.col("ok").alias("__ok"),
        F.col("readable").alias("__readable"),
        F.col("sha256").alias("__sha"),
        F.col("reason").alias("__reason"),
        F.col("at").alias("__at"),
    )
    tried = F.col("__ok").isNotNull()
    state = F.when(~tried, F.col("state")).when(~F.col("__ok"), "error").when(F.col("__readable"), "descargado").otherwise("ilegible")
    return (
        docs.join(o, "doc_id", "left")
        .withColumns(
            {
                "state": state,
                "sha256": F.coalesce("__sha", "sha256"),
                "attempts": F.col("attempts") + tried.cast("int"),
                "last_attempt": F.coalesce("__at", "last_attempt"),
                "reason": F.when(tried, F.col("__reason")).otherwise(F.col("reason")),
            }
        )
        .drop("__ok", "__readable", "__sha", "__reason", "__at")
    )
