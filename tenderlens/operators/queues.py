"""Work queues under caps: ordering first, then limits, then money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.manifest import newest
from .filters import is_it, open_notices
from .joins import not_yet_triaged, ranked_in_scope, readable_candidates, seen_in_scope, unseen_ranks


def placed(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """rows with `place` from 1 within keys; ranks beyond the limit are dropped before the shuffle ends (window group limit)."""
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col("place") <= limit) if limit is not None else out


def triage_queue(current: DataFrame, triage: DataFrame, pairs: DataFrame, today: Column, limit: int = 400) -> DataFrame:
    """Open dossiers each company has not triaged, nearest deadline first."""
    rows = not_yet_triaged(open_notices(current, today), triage, pairs)
    return placed(rows, ["alias"], [F.col("deadline").asc_nulls_last(), F.col("entry_id").asc()], limit)


def scope_queue(current: DataFrame, triage: DataFrame, scopes: DataFrame, scope: str, today: Column, limit: int = 400) -> DataFrame:
    """triage_queue() for companies that look at all dossiers of a scope (alias, scope).

    A scope is put in order once, and a company takes the first places it has not triaged: `limit` rows for each of its
    scopes, however many dossiers and companies meet in it.
    """
    order = [F.col("deadline").asc_nulls_last(), F.col("entry_id").asc()]
    ranked = ranked_in_scope(open_notices(current, today), scope, order)
    free = seen_in_scope(ranked, triage, scopes, scope).select("alias", scope, F.explode(unseen_ranks(limit)).alias("rank"))
    return placed(free.join(ranked, [scope, "rank"]).drop("rank"), ["alias"], order, limit)


def reading_queue(triage: DataFrame, docs: DataFrame, cards: DataFrame, current: DataFrame, limit: int | None = None) -> DataFrame:
    rows = readable_candidates(triage, docs, cards).join(current.select("entry_id", "deadline"), "entry_id")
    return placed(rows, ["alias"], [F.col("deadline").asc_nulls_last(), F.col("entry_id").asc()], limit)


MOST_ATTEMPTS = 3


def download_queue(docs: DataFrame, current: DataFrame, limit: int, kind: str = "PCAP", only_it: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """Documents of a kind still to fetch, of dossiers that are not withdrawn.

    Without `wanted`: those of the latest version, nearest deadline first, on demand only of information
    technology.  With `wanted` (entry_id): those of any version of a dossier that somebody passed, by id.
    """
    rows = docs.where((F.col("kind") == kind) & F.col("state").isin("pendiente", "error") & (F.col("attempts") < MOST_ATTEMPTS))
    alive = current.where("not withdrawn")
    if wanted is not None:
        alive = alive.select("entry_id").join(wanted.select("entry_id").distinct(), "entry_id", "left_semi")
        return rows.join(alive, "entry_id", "left_semi").orderBy("doc_id").limit(limit)
    alive = (alive.where(is_it(F.col("cpv"))) if only_it else alive).select("entry_id", "entry_updated", "deadline")
    return rows.join(alive, ["entry_id", "entry_updated"]).orderBy(F.col("deadline").asc_nulls_last(), "doc_id").limit(limit)


def batch_for_model(queue: DataFrame, n: int = 20) -> DataFrame:
    """queue with its batch (from 0) per company and reference 1..n inside it."""
    place = F.col("place") - 1
    return queue.withColumns({"batch": F.floor(place / n), "ref": (place % n + 1).cast("long")})


def budget_cut(queue: DataFrame, cost: str, cap: Column, spent: Column, reserve: Column | None = None, keys: tuple[str, ...] = ("alias",), order: str = "place") -> DataFrame:
    """queue with `runs`: spent plus all costs before is below the cap or, with a reserve, leaves room for it. Costs are not negative, so this stops at the first failure."""
    before = F.coalesce(F.sum(cost).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = spent + before
    return queue.withColumns({"spent_before": total, "runs": total < cap if reserve is None else total + reserve <= cap})


def affordable_docs(remaining: Column, reserve: Column) -> Column:
    return F.when(reserve <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor(remaining / reserve))).cast("long")


def top_missed(missed: DataFrame, k: int = 4) -> DataFrame:
    """Per company the first k by object, and how many more there are."""
    w = Window.partitionBy("alias")
    rows = missed.withColumn(
        "place",
        F.row_number().over(w.orderBy("object", "entry_id")),
    ).withColumn("more", F.greatest(F.lit(0), F.count(F.lit(1)).over(w) - k))
    return rows.where(F.col("place") <= k)


def pending_plan(queue: DataFrame, reading: DataFrame, companies: DataFrame, reserve: Column, n: int = 20) -> DataFrame:
    """Per client: notices to triage, calls for them, documents to open, and how many of these the cap affords."""
    t = queue.groupBy("alias").agg(F.count(F.lit(1)).alias("to_triage"))
    r = reading.groupBy("alias").agg(F.count(F.lit(1)).alias("to_read"))
    rows = companies.join(t, "alias", "left").join(r, "alias", "left").na.fill(0, ["to_triage", "to_read"])
    return rows.withColumns({
        "calls": F.ceil(F.col("to_triage") / n),
        "affordable": F.least("to_read", affordable_docs(F.col("cap") - F.col("spent"), reserve)),
    })


def lowest_version(rows: DataFrame) -> DataFrame:
    return newest(rows, ["alias", "entry_id"], [F.asc("entry_updated"), F.asc("tie")])
