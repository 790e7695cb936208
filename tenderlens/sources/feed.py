"""Notice feed pages: entries, tombstones, links, monthly archives, originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import attribute

MAX_MEMBER_BYTES = 200 * 1024 * 1024


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, body): one row per file, body whole."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def entries_of(pages: DataFrame) -> DataFrame:
    """(file, position, xml): every entry that begins, positions from 0; what follows an entry's end is no part of it."""
    return pages.select("file", F.posexplode(begun_entries(F.col("body"))).alias("position", "xml"))


def begun_entries(body: Column) -> Column:
    """Entries up to their end tags; one without an end tag goes on to the next entry and is left to quarantine_split()."""
    end = "</entry>"
    parts = F.filter(F.split(body, "<entry>"), lambda _, i: i > 0)
    ended = lambda x: F.concat(F.substring_index(x, end, 1), F.lit(end))
    return F.transform(parts, lambda x: F.concat(F.lit("<entry>"), F.when(F.contains(x, F.lit(end)), ended(x)).otherwise(x)))


def read_feed_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return entries_of(read_pages(spark, path))


def tombstones_of(pages: DataFrame) -> DataFrame:
    """(file, entry_id, deleted_at, reason); those without a reference are left out."""
    after = F.split("body", r"<at:deleted-entry\s")
    ended = F.filter(F.slice(after, 2, F.size(after)), lambda x: F.contains(x, F.lit("</at:deleted-entry>")))
    found = pages.select("file", F.explode(F.transform(ended, lambda x: F.substring_index(x, "</at:deleted-entry>", 1))).alias("t"))
    tag, comment = F.substring_index("t", ">", 1), F.substring_index(F.try_element_at(F.split("t", r"<at:comment\s"), F.lit(2)), ">", 1)
    rows = found.select(
        "file",
        attribute(tag, "ref").alias("entry_id"),
        F.try_to_timestamp(attribute(tag, "when")).alias("deleted_at"),
        attribute(comment, "type").alias("reason"),
    )
    return rows.where("entry_id is not null")


def read_tombstones(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return tombstones_of(read_pages(spark, path))


def next_page_links(pages: DataFrame) -> DataFrame:
    """(file, next_page): null where the feed ends."""
    tags = F.transform(F.split("body", r"<link\s"), lambda x, i: F.when(i > 0, F.substring_index(x, ">", 1)))
    following = F.filter(tags, lambda x: F.contains(x, F.lit('rel="next"')))
    return pages.select("file", attribute(F.try_element_at(following, F.lit(1)), "href").alias("next_page"))


def read_monthly_archive(spark: SparkSession, folder: str, months: list[str]) -> DataFrame:
    """(month, member, position, xml) of unpacked archives folder/month=YYYY-MM/*.atom; partition pruning reads the wanted months."""
    pages = spark.read.option("basePath", folder).text([f"{folder}/month={m}" for m in months], wholetext=True)
    pages = pages.select("month", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("body"))
    return pages.select("month", F.col("file").alias("member"), F.posexplode(begun_entries(F.col("body"))).alias("position", "xml"))


def fetch_original(entries: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers with the entry's xml; `error` says where the position is out of range."""
    found = pointers.join(entries.select(*keys, "xml"), keys, "left")
    return found.withColumn("error", F.when(F.col("xml").isNull(), F.lit("position out of range")))


def oversize_members(files: DataFrame, max_bytes: int = MAX_MEMBER_BYTES) -> DataFrame:
    """Rows of a file listing (path, length) that are too large to be read."""
    return files.where(F.col("length") > max_bytes)
