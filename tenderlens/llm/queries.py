"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    html_extraction,
    jaccard,
    line_dedup,
    lm,
    mixing,
    periodic_runs,
    sharding,
    spelling_variants,
    substring_dedup,
    suffix_dedup,
    topk,
    toxicity,
)
from .oracle import ORACLES  # noqa: F401  (the entry module reads it here)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the unigram base and the maximum-entropy model."""
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without 13-word windows that start in an earlier one."""
    left = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document when sources are mixed to weights 1, 2, 3, repeating."""
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards by proportional stratified interleaving; law `rows`."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = docs.withColumns({"__size": sharding.payload_size(), "__crc": sharding.text_crc32()})
    placed = sharding.assign_shards(rows.drop("text"), measured=("__size", "__crc"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that align with an earlier one, and what is left."""
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"], clean=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of rows not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out("doc_id", 5).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six letters or more that occur five times, with the form and the root of each; one run in 199 loses a letter first."""
    counts = spelling_variants.word_counts(_table(spark, sf_dir, "documents"), id_col="doc_id")
    return spelling_variants.spelling_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by its id's checksum, turns periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size("words")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    periodic = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    chosen = chosen.withColumns({"a": F.when(n > 0, a), "p": F.when(n > 0, p)})
    return chosen.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(periodic, " ")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and digests of them and of what is left without repetitions."""
    found = periodic_runs.periodic_runs(planted(_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document without 100-byte strings that start earlier."""
    left = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_lm_scoring,
    op2_substring_dedup,
    op3_mixing,
    op4_sharding,
    op5_line_dedup,
    op6_html_extraction,
    op7_exact_topk,
    op8_ngram_jaccard_join,
    op9_decontamination,
    op10_toxicity,
    op11_spelling_variants,
    op12_periodic_runs,
    op13_suffix_dedup,
)}
