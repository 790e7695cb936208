"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets share the total by weight under a cap on
repetition, and each document is taken floor(rate) times plus one copy drawn
with the remaining probability from a hash of the seed and its id.  The draw
depends on nothing else, so reruns and retried tasks agree.

Defined results: a null or empty text has size 0; a null source is a source of
its own, ordered last; repeated rows share one draw; an empty table gives an
empty result; with a total of 0 every target and every count is 0.  Extra
columns pass through; working columns start with `__mix_` and may not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import broadcast_within, checkpointed

WORD = r"[^\x20\x09-\x0D]+"
MAX_BROADCAST_SOURCES = 20_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(n: int = 3) -> Column:
    """Weights 1..n by the sources' ordinal `__mix_ordinal`, which starts at 0."""
    return (F.col("__mix_ordinal") % n + 1).cast("long")


def source_targets(sizes: DataFrame, weight: Column, max_rate: int = 3) -> DataFrame:
    """Of (source, source_size): the same with `target`, one row per source.

    Target = least(max_rate * size, level * weight), where the level is raised
    until targets sum to the total: with sources sorted by cap per weight, each
    prefix taken as capped gives a level, and the true level is their maximum.
    The windows run over one row per source, not over documents.
    """
    ordinal = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    capped = sizes.withColumn("__mix_ordinal", ordinal).select(
        "source",
        "source_size",
        weight.alias("__mix_w"),
        (F.col("source_size") * max_rate).alias("__mix_cap"),
    )
    by_ratio = Window.orderBy(F.col("__mix_cap") / F.col("__mix_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    total, weights = F.sum("source_size").over(whole), F.sum("__mix_w").over(whole)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    caps_before, weight_before = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("__mix_cap", "__mix_w"))
    level = (total - caps_before).cast("double") / (weights - weight_before)
    return (
        capped.withColumn("__mix_level", level)
        .withColumn("__mix_level", F.max("__mix_level").over(whole))
        .select("source", "source_size", F.least(F.col("__mix_cap").cast("double"), F.col("__mix_level") * F.col("__mix_w")).alias("target"))
    )


def uniform(seed: int, *ids: str) -> Column:
    """A number in [0, 1) from the leading 32 bits of md5(seed|ids)."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


MADE = ("size", "source_size", "target", "copies")


def _planned(docs: DataFrame, text: str, id_col: str, source: str, weight: Column | None, max_rate: int, seed: int) -> DataFrame:
    """All columns of docs, and those of MADE behind `__mix_`."""
    sized = docs.withColumn("__mix_size", word_count(text))
    sizes = checkpointed(sized.groupBy(F.col(source).alias("source")).agg(F.sum("__mix_size").alias("source_size")))
    targets = source_targets(sizes, cyclic_weights() if weight is None else weight, max_rate)
    targets = targets.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"))
    joined = sized.join(broadcast_within(targets, MAX_BROADCAST_SOURCES), sized[source].eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    rate = F.coalesce(F.try_divide(F.col("__mix_target"), F.col("__mix_source_size")), F.lit(0.0))
    drawn = (uniform(seed, id_col) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("__mix_copies", F.least(F.floor(rate) + drawn, F.lit(max_rate)).cast("long"))


def mixing_plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weight: Column | None = None, max_rate: int = 3, seed: int = 42) -> DataFrame:
    """docs with `size`, `source_size`, `target` and `copies` (replacing such columns of docs).

    weight may use the source's ordinal `__mix_ordinal`; default: 1, 2, 3, repeating.
    """
    plan = _planned(docs, text, id_col, source, weight, max_rate, seed)
    return plan.drop(*MADE).withColumnsRenamed({f"__mix_{c}": c for c in MADE})


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weight: Column | None = None, max_rate: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as mixing_plan() says."""
    plan = _planned(docs, text, id_col, source, weight, max_rate, seed)
    copies = F.explode(F.array_repeat(F.lit(True), F.col("__mix_copies").cast("int")))
    return plan.select(*docs.columns, copies.alias("__mix_copy")).drop("__mix_copy")
