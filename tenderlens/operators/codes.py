"""Deriving a company's code filter from its profile and the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_accents

# Words found in every sector of the vocabulary, which say nothing of a business.
GENERIC = (
    "afines apoyo asistencia clientes diversos empresa empresas especializados generales gestion integral integrales "
    "nuestra nuestros ofrecemos personalizado producto productos profesional profesionales proyecto proyectos realizacion "
    "relacionados sector servicio servicios solucion soluciones suministro suministros trabajo trabajos varios"
).split()
LEAST_LENGTH = 5


def useful_sections(text: Column) -> Column:
    """The bodies of sections 1 and 2, joined; null if there is neither."""
    parts = F.regexp_extract_all(text, F.lit(r"(?ms)^##\s*[12]\.[^\n]*\n(.*?)(?=^##\s*\d+\.|\z)"), 1)
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def profile_terms(text: Column, generic: list[str] = GENERIC, least: int = LEAST_LENGTH) -> Column:
    """Distinct plain words of the text that are long enough and not generic."""
    words = F.regexp_extract_all(strip_accents(text), F.lit("[a-zñ]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*generic)))


def divisions_and_groups(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.where(F.col("code").endswith("0000"))


def seed_codes(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(alias, code): divisions and groups whose description holds a term of (alias, terms) as a word; an equi-join on words."""
    described = divisions_and_groups(vocabulary).select(
        "code",
        F.explode(F.array_distinct(F.regexp_extract_all(strip_accents(F.col("description")), F.lit(r"(?U)\w+"), 0))).alias("word"),
    )
    wanted = terms.select("alias", F.explode("terms").alias("word"))
    return wanted.join(described, "word").select("alias", "code").distinct()


def code_prefix(code: Column) -> Column:
    """The code without its trailing zeros, but never less than its first two digits."""
    short = F.regexp_replace(code, "0+$", "")
    return F.when(F.length(short) < 2, F.substring(code, 1, 2)).otherwise(short)


def code_prefixes(seeds: DataFrame) -> DataFrame:
    """(alias, prefix), each once."""
    return seeds.select("alias", code_prefix(F.col("code")).alias("prefix")).distinct()


def freeze_filters(profiles: DataFrame, seeds: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Per company its codes, prefixes, and what they were derived from: 16 hex digits of the profile's and the vocabulary's sha256.

    The vocabulary's digest is of its rows' own digests in order, which needs no text of it in one row.
    """
    digest = vocabulary.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("|", "code", "description"), 256))), ""), 256).alias("v"))
    lists = seeds.groupBy("alias").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.array_sort(F.collect_set(code_prefix(F.col("code")))).alias("prefixes"),
    )
    rows = profiles.select("alias", F.substring(F.sha2("text", 256), 1, 16).alias("profile_sha")).join(lists, "alias")
    return rows.join(F.broadcast(digest.select(F.substring("v", 1, 16).alias("vocabulary_sha"))))
