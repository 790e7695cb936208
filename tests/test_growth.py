"""Queries whose work has to follow their input: no step of theirs makes rows for every pair of company and dossier."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tenderlens.functions.text import DASHES, QUOTES, collapse, folded, normalise_quote, plain_words
from tenderlens.operators import costs, evidence, filters, joins, metrics, profile, queues, reports, versions
from tenderlens.plans import QUERIES, source_queries
from tenderlens.streaming import version_table

COMPANIES, DOSSIERS = 100, 3000


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """All companies look at all dossiers and let all of them pass: 300,000 pairs from 3,000 order lines."""
    at = str(tmp_path_factory.mktemp("crowded"))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") % 300).cast("int")).cast("timestamp")
    of = lambda n, **columns: spark.range(n).select(*(c.alias(k) for k, c in columns.items()))
    key, one = F.col("id"), F.lit(1).cast("long")
    name = F.concat(F.lit("Supplier#"), F.lpad((key * 100 + 1).cast("string"), 9, "0"))
    tables = {
        "supplier": of(COMPANIES, s_suppkey=key * 100 + 1, s_name=name, s_nationkey=one, s_acctbal=F.lit(1.0)),
        "part": of(COMPANIES, p_partkey=key * 100 + 7, p_name=F.lit("ring"), p_size=F.lit(4).cast("long")),
        "customer": of(1, c_custkey=one, c_nationkey=one),
        "orders": of(DOSSIERS, o_orderkey=key, o_custkey=one, o_orderstatus=F.lit("O"), o_totalprice=F.lit(1.0), o_orderdate=F.date_add(F.lit("1999-01-01").cast("date"), (key % 50).cast("int")).cast("timestamp")),
        "lineitem": of(DOSSIERS, l_orderkey=key, l_partkey=key % COMPANIES * 100 + 7, l_suppkey=key % COMPANIES * 100 + 1, l_linenumber=one, l_shipdate=day, l_linestatus=F.lit("O"), l_returnflag=F.lit("N")),
    }
    for t, df in tables.items():
        df.write.parquet(f"{at}/{t}.parquet")
    return at


def most_rows(df):
    """The most rows that a node of df's plan made, once it has run."""
    df.collect()

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(
    "name",
    [
        "j3_not_yet_triaged", "w1_triage_queue", "w4_batch_for_model", "w5_budget_cut",
        "m1_filter_recall", "m2_filter_volume", "m3i_paired_indicators", "x2_won_and_passing", "m4b_poisson_bootstrap", "m4b_paired_bootstrap",
    ],
)
def test_no_pairs_are_built(spark, crowded, name):
    most = most_rows(QUERIES[name](spark, crowded))
    assert DOSSIERS <= most < COMPANIES * DOSSIERS / 2


def test_scopes_equal_pairs(spark):
    """A company of two scopes, one without triage, one that triaged all of its scope, one listed twice, a dossier without scope."""
    current = spark.range(40).select(
        F.col("id").alias("entry_id"), F.when(F.col("id") < 39, F.col("id") % 3).alias("organ"), (F.col("id") % 7 == 0).alias("withdrawn"),
        F.when(F.col("id") % 4 > 0, F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 5).cast("int"))).alias("deadline"),
    )
    scopes = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("z", 1), ("w", 2), ("w", 2), ("n", None)], "alias string, organ long")
    triage = current.select(F.lit("x").alias("alias"), "entry_id").where("entry_id % 5 = 0").union(current.where("organ = 1").select(F.lit("z"), "entry_id"))
    triage = triage.union(triage)
    pairs = scopes.join(current.select("organ", "entry_id"), "organ").select("alias", "entry_id")
    today = F.lit("2025-01-02").cast("date")
    rows = lambda df: sorted(df.select("alias", "entry_id", "place").collect())
    for limit in (1, 4, 400):
        assert rows(queues.scope_queue(current, triage, scopes, "organ", today, limit)) == rows(queues.triage_queue(current, triage, pairs, today, limit))
    want = joins.not_yet_triaged(current, triage, pairs).groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first"))
    assert sorted(joins.pending_of_scopes(current, triage, scopes, "organ").collect()) == sorted(want.collect())


def test_marks_and_counts_equal_passing(spark):
    """Several codes, none, a prefix too short to count, companies that share a filter."""
    notices = spark.createDataFrame([(1, ["72000000", "48100000"]), (2, ["48"]), (3, []), (4, None), (5, ["90000000"])], "entry_id long, cpv array<string>")
    prefixes = spark.createDataFrame([("x", "72"), ("x", "481"), ("y", "48"), ("z", "48"), ("w", "9"), ("v", "10")], "alias string, prefix string")
    passing = filters.passing(notices, prefixes)
    won = spark.createDataFrame([(a, e) for a in "xyzwvu" for e in range(1, 7)], "alias string, entry_id long")
    assert sorted(filters.marked(won, notices, prefixes, ("72",)).where("B = 1").select("entry_id", "alias").collect()) == sorted(passing.collect())
    assert sorted(filters.passing_pairs(notices, prefixes).collect()) == sorted(passing.collect())
    assert sorted(filters.passing_counts(notices, prefixes).collect()) == sorted(passing.groupBy("alias").count().collect())


def test_pairs_are_dealt_over_tasks(spark):
    """All companies have one filter and all dossiers one list of codes: no task writes out most of the pairs."""
    notices = spark.range(400).select(F.col("id").alias("entry_id"), F.array(F.lit("72000000")).alias("cpv"))
    prefixes = spark.range(300).select(F.concat(F.lit("c"), "id").alias("alias"), F.lit("72").alias("prefix"))
    found = filters.passing_pairs(notices, prefixes, block=50)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) == 400 * 300 == found.distinct().count() and max(tasks) < 400 * 300 / 2


def test_pairs_in_blocks_equal_passing(spark):
    """Members without a name, dossiers without codes, a code twice, blocks of one member and of all."""
    notices = spark.createDataFrame([(1, ["72000000", "48100000"]), (2, ["48"]), (3, []), (4, None), (None, ["48"]), (6, ["48", "48"])], "entry_id long, cpv array<string>")
    prefixes = spark.createDataFrame([("x", "72"), ("x", "481"), ("y", "48"), ("z", "48"), (None, "48"), ("v", "10")], "alias string, prefix string")
    rows = lambda df: sorted(map(str, df.select("entry_id", "alias").collect()))
    for block in (1, 2, 1000):
        assert rows(filters.passing_pairs(notices, prefixes, block)) == rows(filters.passing(notices, prefixes))


def nodes_below(df, kind):
    """Nodes of that class in df's plan, once it has run, with whether they are compiled into one loop with others."""
    df.collect()

    def walk(plan, compiled):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan(), False)
        if name.endswith("QueryStageExec"):
            return walk(plan.plan(), False)
        own = [(plan, compiled)] if name == kind else []
        inside = name == "WholeStageCodegenExec" or compiled and name != "InputAdapter"
        return own + [x for i in range(plan.children().size()) for x in walk(plan.children().apply(i), inside)]

    return walk(df._jdf.queryExecution().executedPlan(), False)


def test_blocks_leave_a_task_in_parts(spark):
    """A compiled loop holds all rows that one row explodes into: one block of 120,000 pairs must not come into it whole."""
    notices = spark.range(400).select(F.col("id").alias("entry_id"), F.array(F.lit("72000000")).alias("cpv"))
    prefixes = spark.range(300).select(F.concat(F.lit("c"), "id").alias("alias"), F.lit("72").alias("prefix"))
    found = filters.passing_pairs(notices, prefixes)
    rows = [(n.metrics().apply("numOutputRows").value(), compiled) for n, compiled in nodes_below(found, "GenerateExec")]
    assert (400 * 300, True) in rows
    parts = [n for n, compiled in rows if not compiled]
    assert parts and 400 * 300 / max(parts) <= filters.PART


@pytest.mark.parametrize("part", [1, 7, 60, 10**6])
def test_parts_hold_every_pair_once(spark, part):
    notices = spark.range(53).select(F.when(F.col("id") > 0, F.col("id")).alias("entry_id"), F.array(F.lit("72000000")).alias("cpv"))
    prefixes = spark.range(20).select(F.when(F.col("id") > 0, F.concat(F.lit("c"), "id")).alias("alias"), F.lit("72").alias("prefix"))
    met = filters.met_blocks(notices, prefixes, part=part)
    assert met.where(F.size("dossiers") * F.size("companies") > F.greatest(F.lit(part), F.size("companies"))).isEmpty()
    rows = lambda df: sorted(map(str, df.select("entry_id", "alias").collect()))
    assert rows(filters.passing_pairs(notices, prefixes, part=part)) == rows(filters.passing(notices, prefixes))


def test_order_lines_are_joined_once_for_pairs(spark, sf_dir):
    """What the pairs are made from, the dossiers and their codes, is kept."""
    plan = QUERIES["f1_company_prefixes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_late_versions_are_not_shuffled(spark):
    """Versions from the end of the period on go before the aggregate; one without an instant does not lend its codes to another."""
    rows = spark.createDataFrame(
        [(1, "1996-05-01", 1, "a"), (1, "1998-05-01", 2, "b"), (2, "1998-01-01", 1, "c"), (3, "1995-01-01", 1, "d"), (3, "1996-02-01", 1, "e"), (4, None, 1, "f"), (4, "1996-03-01", 1, "g"), (5, None, 1, "h"), (6, "1997-01-01", 1, "i"), (7, "1996-01-01", 1, "j")],
        "entry_id long, entry_updated string, tie long, cpv string",
    ).withColumn("entry_updated", F.to_timestamp("entry_updated"))
    found = versions.as_published(rows, "1996-01-01", "1997-01-01")
    assert sorted((r.entry_id, r.cpv) for r in found.collect()) == [(1, "a"), (4, "g"), (7, "j")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "entry_updated" in plan.rsplit("Aggregate", 1)[1] and "< 1997-01-01" in plan.rsplit("Aggregate", 1)[1]


def test_resamples_of_large_keys_come_in_blocks(spark, monkeypatch):
    """Sums put together from blocks of resamples give the same ends as all at once."""
    rows = spark.range(900).select(F.when(F.col("id") < 700, "x").otherwise("y").alias("alias"), F.col("id").alias("entry_id"), (F.col("id") % 3 > 0).cast("int").alias("agent"), (F.col("id") % 2).cast("int").alias("r"))
    whole = sorted(metrics.paired_bootstraps(rows, "agent", ["r"], "s", 500).collect())
    monkeypatch.setattr(metrics, "SLOTS", 70 * 700)
    assert sorted(metrics.paired_bootstraps(rows, "agent", ["r"], "s", 500).collect()) == whole


def test_files_of_the_feed_are_bounded(spark, sf_dir, tmp_path, monkeypatch):
    """A file is read as one text: it holds no more pages on larger tables."""
    monkeypatch.setattr(source_queries, "PAGES_IN_FILE", 20)
    monkeypatch.setattr(source_queries, "scratch", lambda spark: str(tmp_path / "at"))
    assert QUERIES["st1_ingest_stream"](spark, sf_dir).count() > 1000
    files = list(Path(tmp_path / "at" / "in").rglob("part-*"))
    assert files and max(f.read_text().count("<feed>") for f in files) <= 20


def test_current_state_needs_no_python(spark):
    """The state of a dossier is kept by Spark's own aggregates."""
    from tenderlens.streaming.ingest import current_state_stream

    rows = spark.createDataFrame([], "entry_id string, entry_updated timestamp, state string, tombstone boolean")
    plan = current_state_stream(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_poisson_draws_are_dealt_over_tasks(spark):
    """Counts are small, so adaptive execution would draw for all keys in one task."""
    rows = spark.range(400).select((F.col("id") % 40).alias("alias"), F.col("id").alias("entry_id"), (F.col("id") % 3 > 0).cast("int").alias("agent"), (F.col("id") % 2).cast("int").alias("r"))
    found = metrics.poisson_bootstraps(rows, "agent", ["r"], "s", 20)
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


@pytest.mark.parametrize("name", ["p1_parse_notices", "p2_explode_cpv"])
def test_entries_are_split_once(spark, sf_dir, name):
    """Filters on fields do not make the text be split into elements again."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^[^\\s/>]*") == 1


def test_reading_queue_carries_deadlines_only(spark, sf_dir):
    plan = QUERIES["w2_reading_queue"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS deadline#" in plan and "AS object#" not in plan and "AS sme#" not in plan


@pytest.mark.parametrize("name", ["m6x_blind_precision", "m9_work_per_hit", "m1a_triage_recall", "m12_agreement"])
def test_pairs_are_sorted_by_dossier(spark, sf_dir, name):
    """Names of companies begin alike, so that sorting pairs by name first compares whole rows."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join \w+, \(\(entry_id#\d+L = entry_id#\d+L\) AND \(alias", plan)
    assert not re.search(r"Join \w+, \(\(alias#\d+ = alias#\d+\) AND \(entry_id", plan)


@pytest.mark.parametrize("name", ["k4_company_spend", "m9_work_per_hit", "r1_digest_footer", "m8_triage_cost"])
def test_triage_is_made_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(l_suppkey") == 1


def test_recall_and_volume_equal_two_passes(spark):
    """A company without wins, one that triaged only its wins, a decision that is missing."""
    triage = spark.createDataFrame([("x", 1, "si"), ("x", 2, "no"), ("x", 3, None), ("x", 4, "duda"), ("y", 1, "no"), ("z", 5, "si"), ("z", 6, None)], "alias string, entry_id long, decision string")
    won = spark.createDataFrame([("x", 1), ("x", 3), ("x", 9), ("y", 1)], "alias string, entry_id long")
    universe = spark.createDataFrame([(50, 7)], "dossiers long, days long")
    got = metrics.triage_recall_and_volume(triage, won, universe)
    recall = metrics.triage_recall(won, triage).select("alias", "triaged_wins", "seen").collect()
    assert sorted(got.where("triaged_wins > 0").select("alias", "triaged_wins", "seen").collect()) == sorted(recall)
    volume = metrics.triage_volume(triage, won, universe).collect()
    assert sorted(got.where("sample > 0").select("alias", "sample", "passed", "volume").collect()) == sorted(volume)


def test_footer_of_calls_equals_footer(spark):
    """No name, no call, a call that is not known, one without an instant, a repeated one, days on which nothing happened."""
    calls = spark.sql("SELECT * FROM VALUES (1, timestamp'2025-01-01 10:00:00', 1.0D), (2, timestamp'2025-01-02 10:00:00', 2.0D), (2, timestamp'2025-01-03 23:30:00', 3.0D), (3, null, 4.0D), (4, timestamp'2025-01-05 10:00:00', null) AS t(call_id, called_at, cost)")
    rows = [("x", 1, "si"), ("x", 1, "no"), ("x", 2, "duda"), ("x", None, "si"), ("x", 9, "si"), ("y", 3, "si"), (None, 1, "si"), ("z", 4, "no"), ("w", 9, "si")]
    triage = spark.createDataFrame(rows, "alias string, call_id int, decision string")
    timed = triage.join(calls.select("call_id", F.col("called_at").alias("triaged_at")), "call_id")
    days = costs.spend_by_day(calls).agg(F.collect_set("day").alias("days"))
    each = timed.select("alias").distinct().join(days).select("alias", F.explode("days").alias("day"))
    want = reports.digest_footer(each, timed, costs.company_spend(timed, timed.where("false"), calls))
    got = reports.digest_footer_of_calls(days, triage, calls)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cost_of_calls_that_are_not_known(spark):
    """A company without known calls has none; a repeated call counts each time; a key without a name meets no call."""
    triage = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 9), ("y", None), (None, 1)], "alias string, call_id int")
    calls = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 4.0)], "call_id int, cost double")
    got = {r.alias: (r.triaged, r.calls, r.cost, r.per_100) for r in metrics.triage_cost(triage, calls).collect()}
    assert got == {"x": (3, 3, 7.0, round(700 / 3, 4)), "y": (2, None, None, None), None: (1, None, None, None)}


@pytest.mark.parametrize("name", ["e13_reading_rows", "a11_dashboard_counts"])
def test_texts_are_scored_once(spark, sf_dir, name):
    """What several parts of a reading ask for is kept, not worked out from the texts again."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" not in plan and "RLIKE" not in plan


def test_text_pages_equal_trimmed_lengths(spark):
    """White space of all kinds around and inside, lengths about the limit, characters of two units, no text."""
    cores = ["", "a", "a" * 50, "a" * 51, "a" + " " * 48 + "b", "a" + "\n " * 25 + "b", "a" + " " * 200, "😀" * 50, "😀" * 51, "ñ " * 26, "."]
    texts = [a + c + b for c in cores for a in ("", " \n", " " * 60) for b in ("", "\n", "\u0085　" * 40)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for least in (0, 1, 2, 50):
        trimmed = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) > least
        assert rows.select(profile.is_text(least=least).alias("x"), trimmed.alias("y")).where("not (x <=> y)").count() == 0


def test_dashboard_looks_for_no_annexes(spark, sf_dir, monkeypatch):
    """What the dashboard counts does not depend on hops, so that their texts are not scored."""

    def hop(*args, **kwargs):
        raise AssertionError("annexes are looked for")

    want = sorted(QUERIES["a11_dashboard_counts"](spark, sf_dir).where("item = 'documents read'").collect())
    read = QUERIES["e13_reading_rows"](spark, sf_dir).where("state = 'leido'").count()
    assert [r.n for r in want] == [read]
    monkeypatch.setattr(evidence, "locate_annex", hop)
    assert sorted(QUERIES["a11_dashboard_counts"](spark, sf_dir).where("item = 'documents read'").collect()) == want


def test_plain_words_are_found_as_patterns_are(spark):
    """All letters that fold to Latin ones, within words of both cases; patterns that are no plain words stay patterns."""
    assert plain_words("Licensed under|ciónla") == ["licensed under", "ciónla"]
    assert not any(map(plain_words, (r"ISO\s?\d{4,5}", "a||b", "clasificaci[oó]n", "", "a.b")))
    letters = [chr(n) for n in range(0x80, 0x2FFF) if not 0xD800 <= n < 0xE000]
    words = ["sik", "åÿó", "ñßþ", "STILK é", "cióN"]
    texts = [w[:i] + x + w[i + 1 :] for w in words for i in range(len(w)) for x in letters + [w[i].upper(), w[i].lower()]] + ["İx", "x", "sı", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", folded(F.col("text")))
    for w in [*words, "ss|SIK", "x"]:
        plain, pattern = (profile.found("text", w, low) for low in ("low", None))
        assert rows.where(~plain.eqNullSafe(pattern)).collect() == []


def test_quotes_without_foreign_characters_are_not_translated(spark):
    """Every character that quotes may differ in, and those next to them."""
    texts = [f"a{chr(n)}b  c" for n in [*range(0x80, 0x180), *range(0x2000, 0x2040)]] + ["", " a  b\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    source = DASHES + "".join(QUOTES) + "\u00a0\u00ad"
    always = F.translate(F.coalesce("text", F.lit("")), source, "-" * len(DASHES) + "".join(QUOTES.values()) + " ")
    assert rows.where(~normalise_quote(F.col("text"), False).eqNullSafe(collapse(always))).collect() == []


def test_batches_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Rows of a batch and what is stored meet in one shuffle and are written there, a few files a bucket."""
    plans, real = [], version_table.write_batch

    def seen(rows, path, tag):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        real(rows, path, tag)

    monkeypatch.setattr(version_table, "write_batch", seen)
    rows = spark.range(4000).select((F.col("id") % 900).alias("entry_id"), F.timestamp_seconds("id").alias("entry_updated"), F.col("id").alias("tie"))
    for number in range(2):
        tag = version_table.batch_tag("s", number)
        fresh = version_table.append_batch(rows.where(F.col("tie") % 3 != number), str(tmp_path / "v"), rows.columns, tag, buckets=8)
        version_table.update_state(fresh, str(tmp_path / "s"), tag, buckets=8)
    assert [p.count("Exchange") for p in plans] == [1] * 4
    for table in ("v", "s"):
        held = [len(list(d.glob("*.parquet"))) for d in (tmp_path / table).glob("bucket=*/batch=*")]
        assert len(held) == 16 and max(held) <= version_table.SLICES


def test_state_of_nameless_and_undated_versions(spark, tmp_path):
    """A dossier without an id, versions without an instant, which come before all others, and a state asked for in part."""
    parts = [[(None, 5, 1, "a"), ("x", None, 1, "b"), ("y", 7, 1, "c")], [(None, 3, 2, "d"), ("x", 4, 2, "e"), ("y", 7, 2, "f"), ("y", 7, 2, "f")]]
    for number, rows in enumerate(parts):
        batch = spark.createDataFrame(rows, "entry_id string, s long, tie long, winner string")
        batch = batch.select("entry_id", F.timestamp_seconds("s").alias("entry_updated"), "tie", "winner")
        tag = version_table.batch_tag("s", number)
        fresh = version_table.append_batch(batch, str(tmp_path / "v"), ["entry_id", "entry_updated", "tie"], tag, buckets=8)
        changes = version_table.update_state(fresh, str(tmp_path / "s"), tag, buckets=8)
    assert fresh.count() == 3
    state = version_table.read_state(spark, str(tmp_path / "s"), version_table.narrowed(changes.schema, ["entry_updated", "tie", "winner"]))
    assert {(r.entry_id, r.first.winner, r.last.winner) for r in state.collect()} == {(None, "d", "a"), ("x", "b", "e"), ("y", "c", "f")}
