"""Model calls, their cost, and who spends it on which Madrid day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order_statistics import order_statistics, percentile
from ..functions.text import madrid_day

# What cached tokens and batches cost relative to plain input.
CACHE_WRITE, CACHE_READ, BATCH, MILLION = 1.25, 0.10, 0.50, 1_000_000
DEFAULT_RESERVE = 0.15


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, tokens_in, cache_write, cache_read, tokens_out, batch, fx) with `cost`; an unknown model gives `error`."""
    rows = calls.join(prices.select("model", "price_in", "price_out"), "model", "left")
    usd = (F.col("tokens_in") * F.col("price_in") + F.col("cache_write") * F.col("price_in") * CACHE_WRITE + F.col("cache_read") * F.col("price_in") * CACHE_READ + F.col("tokens_out") * F.col("price_out")) / MILLION
    cost = usd * F.when(F.col("batch"), BATCH).otherwise(1.0) * F.col("fx")
    return rows.withColumns({"cost": F.round(cost, 6), "error": F.when(F.col("price_in").isNull(), "unknown model")}).drop("price_in", "price_out")


def fx_for_day(days: DataFrame, rates: DataFrame, default: float) -> DataFrame:
    """days with `fx` and where it comes from."""
    rows = days.join(rates.select("day", F.col("usd_eur").alias("__r")), "day", "left")
    return rows.withColumns({"fx": F.coalesce("__r", F.lit(default)), "fx_origin": F.when(F.col("__r").isNull(), "default").otherwise("rate")}).drop("__r")


def spend_by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(madrid_day(F.col("called_at")).alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def company_spend(triage: DataFrame, readings: DataFrame, calls: DataFrame) -> DataFrame:
    """Per company and Madrid day: distinct calls of triage and reading, and their cost."""
    return spend_of_calls(triage.select("alias", "call_id").union(readings.select("alias", "call_id")), calls)


def spend_of_calls(spent: DataFrame, calls: DataFrame) -> DataFrame:
    """company_spend() of (alias, call_id) pairs, any number of times each."""
    once = spent.select("alias", "call_id").where("call_id is not null").distinct()
    rows = once.join(calls.select("call_id", "called_at", "cost"), "call_id")
    return rows.groupBy("alias", madrid_day(F.col("called_at")).alias("day")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


def reading_reserve(requirements: DataFrame, calls: DataFrame, default: float = DEFAULT_RESERVE) -> DataFrame:
    """One row: the continuous 90th percentile of a reading's cost over its distinct calls."""
    per = requirements.select("doc_id", "call_id").distinct().join(calls.select("call_id", "cost"), "call_id").groupBy("doc_id").agg(F.sum("cost").alias("c"))
    return order_statistics(per, {"p90": ("c", percentile(0.9))}).select(F.round(F.coalesce("p90", F.lit(default)), 6).alias("reserve"))


def over_budget(calls: DataFrame, planned: Column, cap: Column) -> DataFrame:
    """Madrid days on which what was spent and what is planned exceed the cap."""
    return spend_by_day(calls).where(F.col("cost") + planned > cap)


def plan_cost(batches: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """batches (n, chars) with worst-case tokens and cost: four characters a token in, at least 900 and 220 a notice out."""
    tokens_in, tokens_out = F.ceil(F.col("chars") / 4), F.greatest(F.lit(900), 220 * F.col("n"))
    return batches.withColumns({
        "tokens_in": tokens_in,
        "tokens_out": tokens_out,
        "cost": F.round((tokens_in * price_in + tokens_out * price_out) / MILLION, 6),
    })


def running_spend(calls: DataFrame) -> DataFrame:
    w = Window.partitionBy("day").orderBy("called_at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("day", madrid_day(F.col("called_at"))).withColumn("so_far", F.round(F.sum("cost").over(w), 6))
