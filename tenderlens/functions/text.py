"""Text, number and date expressions shared by the operators.

Patterns carry (?iu)(?U), because case folding and classes are ASCII-only otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNICODE = "(?iu)(?U)"
ZONE = "Europe/Madrid"

# Accented letters and what is left of them once combining marks go.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncy"


def strip_accents(c: Column) -> Column:
    """Lower case without accents; ñ becomes n."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def folded(c: Column) -> Column:
    """Text in which plain_words() are searched as they are: lower case, and what (?iu) takes for s and i besides."""
    return F.lower(F.when(c.rlike("[ſıİ]"), F.translate(c, "ſıİ", "sii")).otherwise(c))


def plain_words(pattern: str) -> list[str]:
    """The words of a pattern that is no more than a choice of words in Latin letters, in lower case; none of any other pattern."""
    return pattern.lower().split("|") if re.fullmatch(r"[A-Za-zÀ-ÖØ-Þà-öø-þ |]+", pattern) and "" not in pattern.split("|") else []


def collapse(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_words(c: Column, limit: int) -> Column:
    """At most limit characters, cut at a space, with an ellipsis if anything went."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def spanish_number(c: Column) -> Column:
    """A number as people write it: a comma is the decimal mark; lone points group thousands if three digits follow the last."""
    clean = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    comma = F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    thousands = clean.rlike(r"^(?=[0-9.]*[0-9])[0-9.]+\.[^.]{3}$")
    points = F.when(thousands, F.replace(clean, F.lit("."), F.lit(""))).otherwise(clean)
    return F.when(clean.contains(","), comma).otherwise(points).try_cast("double")


def euros(c: Column, digits: int = 0) -> Column:
    """1.234 € or 1.234,56 €."""
    return F.concat(F.translate(F.format_number(c, digits), ",.", ".,"), F.lit(" €"))


def madrid_day(instant: Column) -> Column:
    """The calendar day of an instant (session zone UTC) in Madrid."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def instant(c: Column) -> Column:
    """A feed date with offset as an instant; null where it is none."""
    return F.try_to_timestamp(c)


def flag(c: Column) -> Column:
    """true, 1, si, sí: true; null stays null; anything else is false."""
    return F.lower(F.trim(c)).isin("true", "1", "si", "sí")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


# Characters that quotes may differ in, and what they count as.
DASHES = "‐‑‒–—"
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
FOREIGN = r"[^\x00-\x9F\xAE-\u200F]"  # all of these are such characters; most texts have none and need no translating


def normalise_quote(c: Column, compatibility: bool = True) -> Column:
    """What comparing quotes ignores: Unicode form, soft hyphens, kinds of dashes and quotes, white space."""
    text = F.coalesce(c, F.lit(""))
    text = nfkc(text) if compatibility else text
    source = DASHES + "".join(QUOTES) + " ­"
    plain = F.translate(text, source, "-" * len(DASHES) + "".join(QUOTES.values()) + " ")
    return collapse(F.when(text.rlike(FOREIGN), plain).otherwise(text))
