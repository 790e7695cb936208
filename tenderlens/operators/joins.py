"""Joins between notices, awards, triage, documents and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.manifest import newest
from .versions import as_published, versions_until


def won_by(companies: DataFrame, awards: DataFrame, notices: DataFrame, first: str, last: str, cutoff: str) -> DataFrame:
    """(alias, entry_id) of distinct dossiers won: award version before the cutoff, dossier first published in the period."""
    period = as_published(notices, first, last).select("entry_id")
    known = versions_until(awards, cutoff).select("entry_id", "winner").distinct()
    return known.join(period, "entry_id", "left_semi").join(companies.select("alias", "winner"), "winner").select("alias", "entry_id").distinct()


def not_yet_triaged(current: DataFrame, triage: DataFrame, companies: DataFrame) -> DataFrame:
    """(alias, current columns): dossiers a company has not triaged in any version; `companies` pairs (alias, entry_id) say which it looks at.

    Dossiers come first, so that what current leaves out is not compared with triage.
    """
    rows = companies.select("alias", "entry_id").join(current, "entry_id").select("alias", *current.columns)
    return rows.join(triage.select("alias", "entry_id").distinct(), ["entry_id", "alias"], "left_anti").select("alias", *current.columns)


def ranked_in_scope(current: DataFrame, scope: str, order: list[Column]) -> DataFrame:
    """current with `rank`, from 1, among the dossiers of equal `scope`."""
    return current.where(F.col(scope).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))


def seen_in_scope(ranked: DataFrame, triage: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """scopes (alias, scope) with `seen`: the ranks of what the company has triaged there.

    not_yet_triaged() for companies that look at all dossiers of a scope: what is left of a scope is told by
    what was triaged of it, so no pairs of companies and dossiers are built.
    """
    own = scopes.select("alias", scope)
    mine = triage.select("alias", "entry_id").join(own.distinct(), "alias").join(ranked.select("entry_id", scope, "rank"), ["entry_id", scope])
    seen = mine.groupBy("alias", scope).agg(F.collect_set("rank").alias("seen"))
    return own.join(seen, ["alias", scope], "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))


def unseen_ranks(limit: int) -> Column:
    """The first `limit` ranks that are not in `seen`."""
    return F.slice(F.array_except(F.sequence(F.lit(1), F.size("seen") + limit), F.col("seen")), 1, limit)


def pending_of_scopes(current: DataFrame, triage: DataFrame, scopes: DataFrame, scope: str) -> DataFrame:
    """Per alias: how many dossiers of its scopes it has not triaged, and the first of them by id."""
    ranked = ranked_in_scope(current.select("entry_id", scope), scope, [F.asc("entry_id")])
    sizes = ranked.groupBy(scope).agg(F.max("rank").alias("n"))
    rows = seen_in_scope(ranked, triage, scopes, scope).join(sizes, scope).withColumn("pending", (F.col("n") - F.size("seen")).cast("long")).where("pending > 0")
    rows = rows.select("alias", scope, "pending", F.get(unseen_ranks(1), F.lit(0)).alias("rank"))
    return rows.join(ranked, [scope, "rank"]).groupBy("alias").agg(F.sum("pending").alias("pending"), F.min("entry_id").alias("first_entry"))


def pending_for_config(sample: DataFrame, triage: DataFrame, keys: list[str]) -> DataFrame:
    """Sample rows without a triage of the same configuration."""
    return sample.join(triage.select(*keys).distinct(), keys, "left_anti")


def readable_candidates(triage: DataFrame, docs: DataFrame, cards: DataFrame) -> DataFrame:
    """(alias, entry_id, decision): passed triage, a downloaded PCAP, no card of that company yet."""
    ready = docs.where("kind = 'PCAP' and state = 'descargado'").select("entry_id").distinct()
    passed = triage.where(F.col("decision").isin("si", "duda"))
    return passed.join(ready, "entry_id", "left_semi").join(
        cards.select("alias", "entry_id").distinct(),
        ["entry_id", "alias"],
        "left_anti",
    ).select("alias", "entry_id", "decision").distinct()


def evaluation_candidates(triage: DataFrame, docs: DataFrame, readings: DataFrame, won: DataFrame, prompt: str) -> DataFrame:
    """As above for a prompt version, with `won`; of the won ones first."""
    ready = docs.where("kind = 'PCAP' and state = 'descargado'").select("entry_id").distinct()
    read = readings.where(F.col("prompt") == prompt).select("alias", "entry_id").distinct()
    wins = won.select("alias", "entry_id", F.lit(True).alias("__won"))
    rows = triage.where(F.col("decision").isin("si", "duda")).select("alias", "entry_id").distinct()
    rows = rows.join(ready, "entry_id", "left_semi").join(read, ["entry_id", "alias"], "left_anti").join(wins, ["entry_id", "alias"], "left")
    return rows.select("alias", "entry_id", F.coalesce("__won", F.lit(False)).alias("won"))


def document_for_dossier(docs: DataFrame) -> DataFrame:
    """The best downloaded PCAP of any version: most pages, then least id."""
    return newest(docs.where("kind = 'PCAP' and state = 'descargado'"), ["entry_id"], [F.desc_nulls_last("pages"), F.asc("doc_id")])


def missed_awards(triage: DataFrame, won: DataFrame, notices: DataFrame) -> DataFrame:
    """(alias, entry_id, object, reason) of dossiers won by a company and triaged `no` by it."""
    refused = triage.where("decision = 'no'").select("alias", "entry_id", "reason")
    return won.join(refused, ["entry_id", "alias"]).join(
        as_published(notices).select("entry_id", "object"),
        "entry_id",
    ).select("alias", "entry_id", "object", "reason")


def lineage(notices: DataFrame, staging: DataFrame, files: DataFrame) -> DataFrame:
    """Every notice row back to its staging row and file; nulls where the chain breaks."""
    return notices.join(staging, "staging_id", "left").join(files, "file_id", "left")


def lineage_of_runs(notices: DataFrame, staging: DataFrame, files: DataFrame, runs: DataFrame) -> DataFrame:
    """lineage() with the run that loaded the file; files name their run."""
    return lineage(notices, staging, files).join(runs, "run_id", "left")


def orphans(lines: DataFrame) -> DataFrame:
    return lines.where("file_id is null or sha256 is null")


def notice_details(current: DataFrame, docs: DataFrame, awards: DataFrame) -> DataFrame:
    """Current notices with their children as sorted lists."""
    d = docs.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct("kind", "url"))).alias("documents"))
    a = awards.groupBy("entry_id").agg(F.array_sort(F.collect_set("winner")).alias("winners"))
    return current.join(d, "entry_id", "left").join(a, "entry_id", "left")


def company_of(study: DataFrame, clients: DataFrame) -> DataFrame:
    """All companies by alias; a study profile takes precedence over a client of that alias."""
    both = study.withColumn("origin", F.lit("estudio")).unionByName(clients.withColumn("origin", F.lit("cliente")), allowMissingColumns=True)
    return newest(both, ["alias"], [F.desc("origin")])


def active_clients(companies: DataFrame) -> DataFrame:
    """Clients by alias with why one may not run."""
    reason = F.when(F.col("origin") == "estudio", "study company").when(~F.coalesce("active", F.lit(False)), "inactive")
    return companies.withColumn("rejected", reason)


def distinct_calls(triage: DataFrame, readings: DataFrame) -> DataFrame:
    """(alias, call_id) spent by triage or reading, each once."""
    return triage.select("alias", "call_id").union(readings.select("alias", "call_id")).where("call_id is not null").distinct()


def inside(won: DataFrame, passing: DataFrame, keys: list[str]) -> DataFrame:
    return won.join(passing.select(*keys).distinct(), keys, "left_semi")


def outside(universe: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    return universe.join(won.select(*keys).distinct(), keys, "left_anti")


