"""Choosing companies and samples, reproducibly: md5 draws in place of a seeded generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import discard_reason, is_it
from .versions import as_published, versions_until


def award_candidates(awards: DataFrame, notices: DataFrame, first: str, last: str, cutoff: str) -> DataFrame:
    """Per winner: name, awards, it_awards and always_sme over its dossiers; a dossier is IT if any version is."""
    period = as_published(notices, first, last).select("entry_id")
    it = notices.groupBy("entry_id").agg(F.bool_or(is_it(F.col("cpv"))).alias("it"))
    known = versions_until(awards, cutoff).where("winner is not null").join(period, "entry_id", "left_semi")
    dossiers = known.groupBy("winner", "entry_id").agg(
        F.max("name").alias("name"),
        F.bool_and(F.coalesce("sme", F.lit(False))).alias("sme"),
    ).join(it, "entry_id")
    return dossiers.groupBy("winner").agg(
        F.max("name").alias("name"),
        F.count(F.lit(1)).alias("awards"),
        F.count_if("it").alias("it_awards"),
        F.bool_and("sme").alias("always_sme"),
    )


def discarded(candidates: DataFrame, person: Column, **rules) -> DataFrame:
    return candidates.withColumn("reason", discard_reason(person, **rules))


def discard_funnel(judged: DataFrame) -> DataFrame:
    """Candidates per reason; `eligible` for those without one."""
    return judged.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("candidates"))


def draw(seed: str, *ids: str) -> Column:
    """A reproducible random order that any engine with md5 agrees on."""
    return F.md5(F.concat(*(F.col(i).cast("string") for i in ids), F.lit(seed)))


LEAST_TEST = 3


def draw_companies(eligible: DataFrame, seed: str, dev: int = 2, test: int = 5, least: int = LEAST_TEST) -> DataFrame:
    """(winner, role, alias): the first dev by draw for development, the next test for testing, lettered in that order.

    Running the result raises an error where fewer than `least` companies are left for testing.
    """
    chosen = eligible.select("winner", F.md5(F.concat(F.lit(seed), F.col("winner").cast("string"))).alias("d")).orderBy("d", "winner").limit(dev + test)
    rank = F.row_number().over(Window.orderBy("d", "winner"))  # over dev + test rows
    role = F.when(F.col("r") <= dev, "desarrollo").otherwise("test")
    drawn = chosen.withColumn("r", rank).select("winner", role.alias("role"), F.concat(F.lit("Empresa "), F.char(F.lit(64) + F.col("r"))).alias("alias"))
    # dev + test rows in one, so that an empty draw raises too
    whole = drawn.agg(F.collect_list(F.struct("winner", "role", "alias")).alias("x"))
    tested = F.greatest(F.size("x") - dev, F.lit(0))
    too_few = F.raise_error(F.concat(F.lit(f"fewer than {least} test companies: "), tested.cast("string")))
    return whole.select(F.explode(F.when(tested >= least, F.col("x")).otherwise(too_few.cast(whole.schema["x"].dataType))).alias("x")).select("x.*")


def stratified_sample(dossiers: DataFrame, won: DataFrame, companies: DataFrame, k: int, seed: str) -> DataFrame:
    """(alias, entry_id, won): all a company won, and the first k of the rest by draw.

    The common draw is cut once to k plus the most wins of a company, which is
    all that k rows beyond anyone's own wins can need.  It is ranked without one
    global sort: draws are dealt by their first four digits, and running sums
    over these counts say which of them hold ranks that matter.
    """
    most = won.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    drawn = dossiers.select("entry_id", draw(seed, "entry_id").alias("d")).withColumn("part", F.substring("d", 1, 4))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 counts at most
    parts = drawn.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(F.broadcast(most), F.col("first") < k + F.col("most")).select("part", "first", "most")
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("d", "entry_id"))
    common = drawn.join(parts, "part").withColumn("r", place).where(F.col("r") <= k + F.col("most")).select("entry_id", "r")
    wins = won.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
    depth = F.lit(k) + F.coalesce("n", F.lit(0))  # as many ranks as a company's own wins can push it down to
    wanted = companies.select("alias").join(wins, "alias", "left").select("alias", F.explode(F.sequence(F.lit(1).cast("long"), depth)).alias("r"))
    pairs = wanted.join(common, "r")
    rest = pairs.join(won.select("alias", "entry_id"), ["entry_id", "alias"], "left_anti")
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("alias").orderBy("r"))).where(F.col("n") <= k)
    return won.select("alias", "entry_id", F.lit(True).alias("won")).unionByName(rest.select("alias", "entry_id", F.lit(False).alias("won")))


def won_first_order(pending: DataFrame, seed: str) -> DataFrame:
    """pending with its place per company: won ones first, then by draw."""
    w = Window.partitionBy("alias").orderBy(F.desc("won"), draw(seed, "entry_id"), "entry_id")
    return pending.withColumn("place", F.row_number().over(w))


def sample_documents(docs: DataFrame, k: int, seed: str) -> DataFrame:
    """k documents of distinct url by draw."""
    once = docs.groupBy("url").agg(F.min("doc_id").alias("doc_id"))
    return once.orderBy(draw(seed, "url"), "url").limit(k)
