"""Exact order statistics and percentiles without gathering a column's values in one task.

Values are counted first, so that frequent ones are one row each.  A place in the
sorted list is then narrowed down: the live range is cut into PARTS equal parts,
parts are counted, running sums over these counts (PARTS rows at most) tell which
part holds the place, and only its values stay live.  Ranges are taken from the
values that are left, so outliers cost one step.  After STEPS steps what is left
of the distinct values, near one in PARTS ** STEPS, is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, STEPS = 1024, 2


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, c): how often each column has each value; nulls are left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("c"))


def values_at(counts: DataFrame, places: DataFrame, steps: int = STEPS, parts: int = PARTS) -> DataFrame:
    """(name, place, value): of value_counts() the value at each place, from 0, of the sorted list; places (name, place) is small."""
    keys = ["name", "place"]
    live = counts.join(F.broadcast(places.select(*keys).distinct()), "name").withColumn("before", F.lit(0).cast("long"))
    for _ in range(steps):
        span = live.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        part = F.least(F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * parts), F.lit(parts - 1))
        cut = live.join(F.broadcast(span), keys).withColumn("part", part).drop("low", "high")
        sizes = cut.groupBy(*keys, "part").agg(F.sum("c").alias("n"), F.first("before").alias("below"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys).orderBy("part"))  # over `parts` rows at most
        held = sizes.withColumn("upto", upto).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
        held = held.select(*keys, "part", (F.col("upto") - F.col("n")).alias("since"))
        live = cut.join(F.broadcast(held), [*keys, "part"]).select(*keys, "value", "c", F.col("since").alias("before"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy("value"))
    return live.withColumn("upto", upto).where("upto > place").groupBy(*keys).agg(F.min("value").alias("value"))


def percentile(share: float) -> Column:
    """Where SQL's percentile_cont finds that share of n values; between two places it interpolates."""
    return (F.col("n") - 1) * share


def order_statistics(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row: per name the value of a column at a place, an expression of its number of values n, from 0; null where there are none."""
    counts = value_counts(df, sorted({c for c, _ in wanted.values()}))
    asked = F.array(*(F.struct(F.lit(c).alias("of"), F.lit(name).alias("as"), at.cast("double").alias("at")) for name, (c, at) in wanted.items()))
    targets = counts.groupBy("name").agg(F.sum("c").alias("n")).select("name", F.explode(asked).alias("x")).where("x.of = name").select("name", "x.as", "x.at")
    targets = targets.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    found = values_at(counts, targets.select("name", F.explode(F.array("low", "high")).alias("place")))
    below = found.select("name", F.col("place").alias("low"), F.col("value").alias("below"))
    above = found.select("name", F.col("place").alias("high"), F.col("value").alias("above"))
    rows = targets.join(F.broadcast(below), ["name", "low"]).join(F.broadcast(above), ["name", "high"])
    between = F.when(F.col("low") == F.col("high"), F.col("below")).otherwise((F.col("high") - F.col("at")) * F.col("below") + (F.col("at") - F.col("low")) * F.col("above"))
    return rows.agg(*(F.max(F.when(F.col("as") == n, between)).alias(n) for n in wanted))
