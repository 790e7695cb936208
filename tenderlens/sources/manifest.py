"""Content-addressed file manifests and how requests reuse them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def extension(content: Column, kind: Column) -> Column:
    """By leading bytes; feed files that begin otherwise are Atom."""
    head = F.hex(F.substring(content, 1, 5))
    return (
        F.when(head.startswith("25504446"), ".pdf").when(head.startswith("504B0304"), ".zip").when(kind == "feed", ".atom").when(head == "3C3F786D6C", ".xml").otherwise(".bin")
    )


def file_manifest(files: DataFrame, kind: Column) -> DataFrame:
    """(sha256, path, bytes, extension, kind): the same content once, under its first path."""
    rows = files.select(
        F.sha2("content", 256).alias("sha256"),
        "path",
        F.octet_length("content").cast("long").alias("bytes"),
        extension(F.col("content"), kind).alias("extension"),
        kind.alias("kind"),
    )
    least = F.min_by(F.struct("path", "bytes", "extension", "kind"), "path").alias("f")
    return rows.groupBy("sha256").agg(least).select("sha256", "f.*")


def reuse_by_url(requests: DataFrame, manifests: DataFrame, first_page: str | None = None) -> DataFrame:
    """Requests (url) with the stored sha256, from the manifest of least rank; the feed's first page is always asked for again."""
    best = manifests.groupBy("url").agg(F.min_by("sha256", F.struct("rank", "sha256")).alias("sha256"))
    found = requests.join(best, "url", "left")
    return found.withColumn("sha256", F.when(F.col("url") != first_page, F.col("sha256"))) if first_page is not None else found


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
