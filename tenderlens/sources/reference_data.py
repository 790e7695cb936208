"""Code vocabularies, frozen filters and profiles, from XML and Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import attribute, blocks, first_block, given, unescape
from ..operators.codes import code_prefix


def read_cpv_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(code, description) of a genericode file; an error where it holds no row with both."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(blocks(F.col("value"), "Row")).alias("row"))
    cell = lambda name: F.try_element_at(
        F.filter(F.split("row", r"<Value\s"), lambda x: attribute(F.substring_index(x, ">", 1), "ColumnRef") == name),
        F.lit(1),
    )
    value = lambda name: given(F.trim(unescape(first_block(cell(name), "SimpleValue"))))
    found = rows.select(value("code").alias("code"), value("nombre").alias("description")).where("code is not null and description is not null")
    if found.isEmpty():
        raise ValueError(f"{path} is no vocabulary in the expected format")
    return found


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))


def frozen_filters(files: DataFrame) -> DataFrame:
    """(alias, prefixes) of freeze files; those without an `- Empresa:` line are no freezes, `todas` applies to all (null alias)."""
    alias = F.trim(F.regexp_extract("text", r"(?m)^- Empresa:\s*(.+)$", 1))
    codes = F.regexp_extract_all("text", F.lit(r"(?m)^\|\s*`?(\d+)`?\s*\|"), 1)
    rows = files.select(alias.alias("alias"), F.explode_outer(codes).alias("code")).where("alias <> ''")
    rows = rows.withColumn("alias", F.when(~F.lower("alias").startswith("todas"), F.col("alias")))
    return rows.groupBy("alias").agg(F.array_sort(F.collect_set(code_prefix(F.col("code")))).alias("prefixes"))


def profiles(files: DataFrame) -> DataFrame:
    """(alias, text, sha256, sources, error) of files perfil_empresa_x.md."""
    letter = F.regexp_extract("name", r"^perfil_empresa_(\w+)\.md$", 1)
    section = F.regexp_extract("text", r"(?ms)^##\s*Fuentes[^\n]*\n(.*?)(?=^##|\z)", 1)
    sources = F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^[-*]\s+(.+)$"), 1), lambda x: F.trim(x))
    return files.where(letter != "").select(
        F.concat(F.lit("Empresa "), F.upper(letter)).alias("alias"),
        "text",
        F.sha2("text", 256).alias("sha256"),
        sources.alias("sources"),
        F.when(F.size(sources) == 0, "no sources").alias("error"),
    )
