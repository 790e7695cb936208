"""Queries on files and streams that Spark first writes from the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import feed, reference_data
from ..streaming import ingest, version_table
from ..streaming.replay import replay_stages, rocksdb_state, scratch
from .registry import query
from .text_queries import _feed
from .views import FIRST, LAST, Views


def _escaped(c: Column) -> Column:
    """Text as files of the feed hold it: ampersands and one letter as references."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("ñ"), F.lit("&ntilde;"))


# -- archives, vocabulary, freeze files, profiles ----------------------------


@query(
    "",
    "SELECT m AS month, count(*) AS entries, count(DISTINCT k) AS dossiers FROM (SELECT o_orderkey AS k, "
    "CAST(2020 + o_custkey % 3 AS VARCHAR) || '-0' || CAST(o_custkey % 7 + 1 AS VARCHAR) AS m FROM orders) x "
    "WHERE m <> '2021-03' GROUP BY 1",
)
def s4_read_monthly_archive(v: Views) -> DataFrame:
    at = scratch(v.spark)
    key = F.col("file").cast("long")
    month = F.concat((2020 + key % 3).cast("string"), F.lit("-0"), (key % 7 + 1).cast("string"))
    _feed(v).select(month.alias("month"), "body").write.partitionBy("month").text(at)
    held = sorted(r.month for r in _feed(v).select(month.alias("month")).distinct().collect())  # months: a handful
    entries = feed.read_monthly_archive(v.spark, at, [m for m in held if m != "2021-03"])
    number = F.regexp_extract("xml", r"<id>(\d+)</id>", 1)
    return entries.groupBy(F.date_format(F.concat(F.col("month").cast("string"), F.lit("-01")).cast("date"), "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_distinct(number).alias("dossiers"),
    )


@query("vocabulary", "SELECT code, description || ' & mañana' AS description FROM vocabulary")
def s9_read_cpv_vocabulary(v: Views) -> DataFrame:
    at = scratch(v.spark)
    cell = lambda name, text: F.concat(F.lit(f'<Value ColumnRef="{name}"><SimpleValue>'), text, F.lit("</SimpleValue></Value>"))
    description = _escaped(F.concat("description", F.lit(" & mañana")))
    v.vocabulary.select(F.concat(F.lit("<Row>"), cell("code", F.col("code")), cell("nombre", description), F.lit("</Row>")).alias("value")).write.text(at)
    return reference_data.read_cpv_vocabulary(v.spark, at)


_CODES = (
    "SELECT DISTINCT p_brand AS alias, lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') || CASE "
    "WHEN p_size % 2 = 0 THEN '0000' ELSE '1000' END AS code FROM part"
)
_PREFIX = "CASE WHEN length(rtrim(code, '0')) < 2 THEN substr(code, 1, 2) ELSE rtrim(code, '0') END"


@query(
    "",
    f"SELECT alias, string_agg(DISTINCT {_PREFIX}, ',' ORDER BY {_PREFIX}) AS prefixes FROM (SELECT CASE "
    f"WHEN alias <> 'Brand#1' THEN alias END AS alias, code FROM ({_CODES}) c WHERE alias <> 'Brand#2') x GROUP BY alias",
)
def s10_frozen_filters(v: Views) -> DataFrame:
    """Freeze files of all brands: the first one's holds for all, the second one's names no company."""
    at = scratch(v.spark)
    code = F.concat(F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"), F.when(F.col("p_size") % 2 == 0, "0000").otherwise("1000"))
    rows = v.table("part").select(F.col("p_brand").alias("brand"), code.alias("code")).distinct().groupBy("brand").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    head = F.when(F.col("brand") == "Brand#1", "- Empresa: todas\n").when(F.col("brand") == "Brand#2", "").otherwise(F.concat(F.lit("- Empresa: "), "brand", F.lit("\n")))
    table = F.array_join(F.transform("codes", lambda c: F.concat(F.lit("| "), c, F.lit(" | texto |"))), "\n")
    rows.select(
        "brand",
        F.concat(F.lit("# Filtro\n"), head, F.lit("\n| código | nombre |\n|---|---|\n"), table).alias("text"),
    ).write.partitionBy("brand").text(at)
    files = reference_data.read_documents(v.spark, at)
    return reference_data.frozen_filters(files).select("alias", F.array_join("prefixes", ",").alias("prefixes"))


@query(
    "",
    "SELECT 'Empresa ' || upper(k) AS alias, sha256(text) AS sha256, CASE WHEN n % 4 > 0 THEN 'fuente ' || k || ',otra' ELSE '' END AS sources, CASE WHEN n % 4 = 0 THEN 'no sources' END AS error FROM ("
    "SELECT *, '## 1. Qué hace' || chr(10) || 'texto ' || k || chr(10) || '## Fuentes' || chr(10) || CASE WHEN n % 4 > 0 THEN '- fuente ' || k || chr(10) || '* otra' || chr(10) ELSE '' END || '## Fin' || chr(10) AS text FROM (SELECT s_suppkey AS n, 's' || CAST(s_suppkey AS VARCHAR) AS k FROM supplier) a) b",
)
def s11_profiles(v: Views) -> DataFrame:
    n, k = F.col("s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    bullets = F.when(n % 4 > 0, F.concat(F.lit("- fuente "), k, F.lit("\n* otra\n"))).otherwise("")
    text = F.concat(F.lit("## 1. Qué hace\ntexto "), k, F.lit("\n## Fuentes\n"), bullets, F.lit("## Fin\n"))
    name = F.concat(F.lit("perfil_empresa_"), k, F.lit(".md"))
    files = v.table("supplier").select(name.alias("name"), text.alias("text"))
    others = v.table("supplier").select(F.concat(F.lit("notas_"), k, F.lit(".md")).alias("name"), text.alias("text"))
    return reference_data.profiles(files.union(others)).select("alias", "sha256", F.array_join("sources", ",").alias("sources"), "error")


# -- streams -----------------------------------------------------------------

PAGES_IN_FILE = 500  # a file of the feed is read as one text, so it must not grow with the table


@query(
    "",
    "SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, CASE "
    "WHEN o_orderkey % 13 > 0 THEN o_orderdate - INTERVAL 1 HOUR END AS entry_updated, CASE "
    "WHEN o_orderkey % 13 = 0 THEN 'unreadable date: ayer' END AS reason FROM orders",
)
def st1_ingest_stream(v: Views) -> DataFrame:
    """Pages arrive in three folders; the third brings pages again that the first brought, and the job is started anew for each."""
    at = scratch(v.spark)
    pages = _feed(v).select("body", (F.col("file").cast("long") % 3).alias("part"))
    for part in (0, 1, 2):
        own = pages.where((F.col("part") == part) | (F.col("part") == 0) & F.lit(part == 2))
        own.select("body").write.option("maxRecordsPerFile", PAGES_IN_FILE).text(f"{at}/in/{part}")
        ingest.ingest_stream(v.spark, f"{at}/in", f"{at}/silver", f"{at}/bad", f"{at}/state", buckets=8).awaitTermination()
    good = v.spark.read.parquet(f"{at}/silver").select("entry_id", "entry_updated", F.lit(None).cast("string").alias("reason"))
    bad = v.spark.read.parquet(f"{at}/bad").select("entry_id", F.lit(None).cast("timestamp").alias("entry_updated"), "reason").distinct()
    return good.union(bad)


@query(
    "versions",
    "SELECT entry_id, min(entry_updated) AS first_updated, max(entry_updated) AS last_updated, arg_min(winner, (entry_updated, tie)) AS first_winner, "
    "arg_max(winner, (entry_updated, tie)) AS last_winner FROM versions GROUP BY 1",
)
def st5_version_state(v: Views) -> DataFrame:
    """Versions come in four batches, the last of which brings all of the first again; the state is what the batches' changes add up to."""
    at = scratch(v.spark)
    rows = v.versions.withColumn("part", F.pmod(F.xxhash64("entry_id", "tie"), F.lit(3)))
    for number in range(4):
        batch = rows.where(F.col("part") == number % 3).drop("part")
        fresh = version_table.append_batch(batch, f"{at}/versions", ["entry_id", "entry_updated", "tie"], version_table.batch_tag(at, number), buckets=8)
        changes = version_table.update_state(fresh, f"{at}/state", version_table.batch_tag(at, number), buckets=8)
    state = version_table.read_state(v.spark, f"{at}/state", version_table.narrowed(changes.schema, ["entry_updated", "tie", "winner"]))
    return state.select(
        "entry_id",
        F.col("first.entry_updated").alias("first_updated"),
        F.col("last.entry_updated").alias("last_updated"),
        F.col("first.winner").alias("first_winner"),
        F.col("last.winner").alias("last_winner"),
    )


@query(
    "versions",
    f"SELECT entry_id FROM (SELECT entry_id, min(entry_updated) AS a FROM versions WHERE entry_updated >= TIMESTAMP '{FIRST}' GROUP BY 1) b "
    f"WHERE a < TIMESTAMP '{LAST}' AND entry_id IN (SELECT entry_id FROM versions WHERE entry_updated < TIMESTAMP '{FIRST}')",
)
def q10_moved_by_backfill(v: Views) -> DataFrame:
    """The months before the period are loaded last: that batch's changes name the dossiers that leave the period."""
    at, first = scratch(v.spark), F.lit(FIRST).cast("timestamp")
    for number, batch in enumerate((v.versions.where(F.col("entry_updated") >= first), v.versions.where(F.col("entry_updated") < first))):
        changes = version_table.update_state(batch, f"{at}/state", version_table.batch_tag(at, number), buckets=8)
    return version_table.moved_out(changes, FIRST, LAST)


@query("versions", "SELECT DISTINCT entry_id, entry_updated FROM versions")
def st2_dedupe_versions(v: Views) -> DataFrame:
    """Every version comes in one of two batches, and a third batch brings all of them again."""
    once = v.versions.select("entry_id", "entry_updated", (F.col("entry_id") % 2).cast("int").alias("part"))
    rows = once.union(once.withColumn("part", F.lit(2)))
    out = replay_stages(rows, F.col("part"), 3, lambda s: ingest.dedupe_versions(s.drop("part"), "4000 days"), "append")
    return out.drop("batch")


@query(
    "",
    (
        "SELECT o_custkey AS k, max(o_orderdate) AS entry_updated, arg_max(o_orderstatus, (o_orderdate, "
        "o_orderstatus)) AS state, any_value(c_acctbal) < 0 AS withdrawn FROM orders JOIN customer ON c_custkey = o_custkey "
        "GROUP BY 1"
    ),
)
def st3_current_state_stream(v: Views) -> DataFrame:
    """Orders as versions of their customer's dossier, in three batches out of order; tombstones, for customers in debt, come first."""
    versions = v.table("orders").select(
        F.col("o_custkey").cast("string").alias("entry_id"), F.col("o_orderdate").cast("timestamp").alias("entry_updated"), F.col("o_orderstatus").alias("state"),
        F.lit(False).alias("tombstone"), (F.col("o_orderkey") % 3).cast("int").alias("part"),
    )
    gone = v.table("customer").where("c_acctbal < 0").join(v.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    none = F.lit(None)
    gone = gone.select(
        F.col("c_custkey").cast("string").alias("entry_id"),
        none.cast("timestamp").alias("entry_updated"),
        none.cast("string").alias("state"),
        F.lit(True).alias("tombstone"),
        F.lit(0).alias("part"),
    )
    with rocksdb_state(v.spark):
        out = replay_stages(versions.union(gone), F.col("part"), 3, lambda s: ingest.current_state_stream(s.drop("part")), "update")
    last = out.groupBy("entry_id").agg(F.max_by(F.struct("entry_updated", "state", "withdrawn"), "batch").alias("s"))
    return last.select(F.col("entry_id").cast("long").alias("k"), "s.entry_updated", "s.state", "s.withdrawn")


@query(
    "",
    "SELECT event_type AS alias, CAST(timezone('Europe/Madrid', timezone('UTC', ts)) AS DATE) AS day, count(*) AS calls, "
    "round(sum(value), 4) AS cost FROM events GROUP BY 1, 2",
)
def st6_spend_stream(v: Views) -> DataFrame:
    """Three batches by date; half of a batch's last day comes a batch late, within the lateness."""
    calls = v.table("events").select(
        F.col("event_type").alias("alias"),
        F.col("ts").cast("timestamp").alias("called_at"),
        F.col("value").alias("cost"),
        (F.col("event_id") % 2).alias("half"),
    )
    day = F.dayofmonth("called_at")
    batch = F.when(day < 10, 0).when(day == 10, F.col("half").cast("int")).when(day < 20, 1).when(day == 20, 1 + F.col("half").cast("int")).otherwise(2)
    out = replay_stages(calls, batch, 3, lambda s: ingest.spend_stream(s.drop("half")), "update")
    last = out.groupBy("alias", "day").agg(F.max_by(F.struct("calls", "cost"), "batch").alias("s"))
    return last.select("alias", "day", "s.calls", F.round("s.cost", 4).alias("cost"))
