"""Natural persons never leave these operators in clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: first letters of Spanish company ids.
COMPANY_LETTERS = "ABCDEFGHJNPQRSUVW"
PREFIX = "pf_"


def is_natural_person(nif: Column) -> Column:
    """Whether an id is a person's (or a person's pseudonym); false for null and empty."""
    first = F.substring(F.upper(F.trim(nif)), 1, 1)
    return F.coalesce((nif != "") & (nif.startswith(PREFIX) | ~first.isin(*COMPANY_LETTERS)), F.lit(False))


def pseudonym(nif: Column, salt: str) -> Column:
    return F.when(nif.startswith(PREFIX), nif).otherwise(F.concat(F.lit(PREFIX), F.substring(F.sha2(F.concat(F.lit(salt), F.upper(F.trim(nif))), 256), 1, 24)))


def pseudonymise_awards(awards: DataFrame, salt: str, nif: str = "winner", name: str = "name") -> DataFrame:
    person = is_natural_person(F.col(nif))
    return awards.withColumns({nif: F.when(person, pseudonym(F.col(nif), salt)).otherwise(F.col(nif)), name: F.when(~person, F.col(name))})


def anonymise_existing(awards: DataFrame, salt: str, nif: str = "winner", name: str = "name") -> DataFrame:
    """One row: rows changed, and distinct persons among them, if stored awards were pseudonymised."""
    clear = is_natural_person(F.col(nif)) & ~F.col(nif).startswith(PREFIX)
    named = is_natural_person(F.col(nif)) & F.col(name).isNotNull()
    return awards.agg(F.count_if(clear | named).alias("rows_changed"), F.count_distinct(F.when(clear, pseudonym(F.col(nif), salt))).alias("persons"))


def plaintext_ids(awards: DataFrame, nif: str = "winner", name: str = "name") -> DataFrame:
    """Awards that break the rule: a person's id in clear, or a pseudonym with a name."""
    pseudo = F.col(nif).startswith(PREFIX)
    rule = F.when(is_natural_person(F.col(nif)) & ~pseudo, "id in clear").when(pseudo & F.col(name).isNotNull(), "pseudonym with name")
    return awards.withColumn("rule", rule).where("rule is not null")
