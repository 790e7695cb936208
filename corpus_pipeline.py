"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Every stage takes whole tables and returns docs' own columns, whatever their names; the last adds size,
text_crc32, shard and slot and replaces columns of those names.  Rows are judged one by one, so null ids and
repeated ids or rows need no care of the caller's.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderlens.llm import cluster, decontamination, jaccard, mixing, sharding, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PLACED = ["size", "text_crc32", "shard", "slot"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from `labels`, does not call toxic; null and empty texts stay."""
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by five-word similarity of 0.8 or more.

    Of a group the row with the smallest id stays, a null id only where the group has no other; of rows
    that share it, the first by its values.  All null and empty texts are one group.
    """
    return jaccard.keep_one(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth; null and empty texts stay."""
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"), clean=False, prefix="__dec_")
    return found.where("not __dec_contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; a null source is one, repeated rows share a draw."""
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot; repeated rows are rows of their own."""
    return sharding.assign_shards(docs).select(*(c for c in docs.columns if c not in PLACED), *PLACED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: stage one is a trained model. tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table is discarded once the next one is written."""
    docs, at = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, fresh = cluster.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if at:
            cluster.discard(spark, at)
        at = fresh
    return STAGES[-1][1](spark, docs, sf_dir)
