"""Small hand-made tables with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tenderlens.functions.text import collapse, euros, first_words, flag, instant, madrid_day, normalise_quote, spanish_number, strip_accents
from tenderlens.operators import checks, codes, cohort, costs, evidence, filters, joins, metrics, privacy, profile, queues, reports, rules, triage, versions


def day(s):
    return dt.datetime.fromisoformat(s)


NOTICES = "entry_id string, entry_updated timestamp, tie long, cpv array<string>, object string"


def test_poisson_quantiles_are_those_of_summed_terms():
    u = np.array([1e-9, 0.01, 0.3679, 0.5, 0.9, 0.999999])
    for n in (1, 2, 7, 40, 130):
        term, cdf = math.exp(-n), [math.exp(-n)]
        for j in range(1, 400):
            term *= n / j
            cdf.append(cdf[-1] + term)
        assert metrics.poisson_quantiles(n, u).tolist() == [next(j for j, c in enumerate(cdf) if c >= x) for x in u]
    big = metrics.poisson_quantiles(10**9, np.array([0.025, 0.5, 0.975]))
    assert abs(big - (10**9 + np.array([-1.96, 0, 1.96]) * 10**4.5)).max() < 100


def test_poisson_intervals_agree_with_exact_resampling(spark):
    """Two companies of 1,500 and 600 contracts: both methods' ends within Monte-Carlo error, whatever the partitions."""
    n = F.when(F.col("id") < 1500, "x").otherwise("y")
    bit = lambda salt, of: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10)) < of).cast("int")
    rows = spark.range(2100).select(n.alias("alias"), F.col("id").alias("entry_id"), bit(1, 7).alias("agent"), bit(2, 5).alias("r1"), bit(3, 7).alias("r2"))
    exact = {(r.alias, r.rival): r for r in metrics.paired_bootstraps(rows, "agent", ["r1", "r2"], "s", 1000).collect()}
    found = {(r.alias, r.rival): r for r in metrics.poisson_bootstraps(rows, "agent", ["r1", "r2"], "s", 1000).collect()}
    assert found == {(r.alias, r.rival): r for r in metrics.poisson_bootstraps(rows.repartition(7), "agent", ["r1", "r2"], "s", 1000).collect()}
    assert found.keys() == exact.keys() and len(found) == 4
    for k, e in exact.items():
        p, error = found[k], 0.75 / math.sqrt(e.n)
        assert (p.n, p.difference) == (e.n, e.difference) and p.low < p.difference < p.high
        assert abs(p.low - e.low) < 0.35 * error and abs(p.high - e.high) < 0.35 * error


def test_poisson_interval_of_few_contracts(spark):
    """Two equal contracts: empty resamples are left out, all others agree; no contract, no row."""
    rows = spark.createDataFrame([("x", 1, 1, 0), ("x", 2, 1, 0)], "alias string, entry_id long, agent int, r int")
    found = metrics.poisson_bootstraps(rows, "agent", ["r"], "s", 100)
    assert found.collect() == [("x", "r", 2, 1.0, 1.0, 1.0)]
    assert metrics.poisson_bootstraps(rows.where("false"), "agent", ["r"], "s", 100).count() == 0


@pytest.fixture(scope="module")
def scenario(spark):
    """Five notices over four days; A won three, of which two have code 72."""
    rows = [
        ("n1", day("2025-01-01"), 1, ["72000000"], "a"),
        ("n2", day("2025-01-02"), 1, ["48000000"], "b"),
        ("n3", day("2025-01-02"), 1, ["30000000"], "c"),
        ("n4", day("2025-01-03"), 1, ["45000000"], "d"),
        ("n5", day("2025-01-04"), 1, ["72100000"], "e"),
    ]
    won = [("A", "n1"), ("A", "n2"), ("A", "n3")]
    return spark.createDataFrame(rows, NOTICES), spark.createDataFrame(won, "alias string, entry_id string")


def passing(notices, *prefixes):
    return filters.cpv_prefix_filter(notices, prefixes).select(F.lit("A").alias("variant"), F.lit(None).cast("string").alias("alias"), "entry_id")


def test_recall_and_volume(spark, scenario):
    notices, won = scenario
    row = metrics.filter_recall(won, passing(notices, "72", "48")).first()
    assert (row.won, row.seen, row.value) == (3, 2, 0.6667)
    assert metrics.filter_recall(won, passing(notices, "72", "48", "30")).first().value == 1.0
    universe = profile.universe(notices, "2025-01-01", "2025-02-01")
    assert tuple(universe.first()) == (5, 4)
    assert metrics.filter_volume(passing(notices, "72", "48"), universe).first().value == 0.75


def test_filters_judge_the_first_version_and_wins_any_before_the_cutoff(spark):
    rows = [
        ("n1", day("2025-01-01"), 1, ["45000000"], "a"),
        ("n1", day("2025-01-05"), 1, ["72000000"], "a"),
        ("n2", day("2024-12-31"), 1, ["72000000"], "b"),
        ("n2", day("2025-01-09"), 1, ["72000000"], "b"),
    ]
    notices = spark.createDataFrame(rows, NOTICES)
    assert [(r.entry_id, r.cpv) for r in versions.as_published(notices, "2025-01-01", "2025-02-01").collect()] == [("n1", ["45000000"])]
    assert {r.entry_id: r.cpv for r in versions.latest_versions(notices).collect()} == {"n1": ["72000000"], "n2": ["72000000"]}
    companies = spark.createDataFrame([("A", "w")], "alias string, winner string")
    awards = notices.select("entry_id", "entry_updated", F.lit("w").alias("winner"))
    won = lambda cutoff: sorted(r.entry_id for r in joins.won_by(companies, awards, notices, "2025-01-01", "2025-02-01", cutoff).collect())
    assert won("2025-01-01") == [] and won("2025-01-02") == ["n1"]


def test_versions_do_not_depend_on_row_order(spark):
    rows = [("n", day("2025-01-01"), t, [f"{t}"], "x") for t in (5, 3, 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, NOTICES).repartition(3)
        assert versions.latest_versions(df).first().tie == 9 and versions.as_published(df).first().tie == 3


def test_tombstones_win_whenever_they_come(spark):
    notices = spark.createDataFrame([("a", day("2025-01-09"), 1, ["72"], "x"), ("b", day("2025-01-09"), 1, ["72"], "x")], NOTICES)
    stones = spark.createDataFrame([("a", day("2020-01-01")), ("z", day("2020-01-01"))], "entry_id string, deleted_at timestamp")
    assert {r.entry_id: r.withdrawn for r in versions.current_with_tombstones(notices, stones).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize(("code", "prefix"), [("30000000", "30"), ("03000000", "03"), ("72250000", "7225"), ("80000000", "80"), ("72000001", "72000001")])
def test_code_prefixes(spark, code, prefix):
    assert spark.range(1).select(codes.code_prefix(F.lit(code)).alias("p")).first().p == prefix


def test_seed_codes_meet_profile_words(spark):
    text = "# P\n\n## 1. Qué hace\n\nDesarrollo de programación y páginas web; empresa de servicios.\n\n## 2. Busca\n\nSistemas informáticos\n\n## 3. Otros\n\nmadera carpintería\n"
    profiles = spark.createDataFrame([("A", text)], "alias string, text string").select(
        "alias",
        codes.profile_terms(codes.useful_sections(F.col("text"))).alias("terms"),
    )
    assert set(profiles.first().terms) == {"desarrollo", "programacion", "paginas", "busca", "sistemas", "informaticos"} - {"busca"}
    rows = [
        ("48000000", "Paquetes de software y sistemas de información"),
        ("72000000", "Servicios TI: programación"),
        ("45000000", "Trabajos de construcción"),
        ("03000000", "Madera"),
        ("72200001", "Sistemas"),
    ]
    assert sorted(r.code for r in codes.seed_codes(
        profiles,
        spark.createDataFrame(rows, "code string, description string"),
    ).collect()) == ["48000000", "72000000"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1.00", 1.0),
        ("850.000", 850000.0),
        ("1.234,56", 1234.56),
        ("0,50", 0.5),
        ("0.07", 0.07),
        (" 1 200 ", 1200.0),
        ("lo que sea", None),
        ("", None),
        (None, None),
        ("1.234.567", 1234567.0),
        (".500", 0.5),
    ],
)
def test_spanish_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(spanish_number(F.col("t")).alias("v")).first().v == value


def test_text_functions(spark):
    df = spark.createDataFrame([("  Économía ñandú \n x ", 1234.5, "2026-09-04T13:09:10.007+02:00", "Sí")], "t string, n double, d string, f string")
    row = df.select(
        strip_accents(F.col("t")).alias("a"),
        collapse(F.col("t")).alias("b"),
        euros(F.col("n"), 2).alias("c"),
        instant(F.col("d")).alias("d"),
        flag(F.col("f")).alias("e"),
        first_words(F.lit("uno dos tres"), 9).alias("g"),
        madrid_day(F.lit("2026-09-28 22:30:00").cast("timestamp")).alias("h"),
    ).first()
    assert row.a == "  economia nandu \n x " and row.b == "Économía ñandú x" and row.c == "1.234,50 €" and row.d == day("2026-09-04T11:09:10.007000") and row.e and row.g == "uno dos…" and row.h == dt.date(2026, 9, 29)


def test_natural_persons(spark):
    rows = [("B12345678", "Firma"), ("12345678Z", "Ana"), ("x1234567l", "Eva"), ("X1234567L", "Eva"), (None, "?"), ("", "?"), (" b1", "Otra")]
    out = privacy.pseudonymise_awards(spark.createDataFrame(rows, "winner string, name string"), "sal")
    twice = privacy.pseudonymise_awards(out, "sal")
    got = out.collect()
    assert got == twice.collect()
    assert got[0].winner == "B12345678" and got[1].winner.startswith("pf_") and len(got[1].winner) == 27 and got[1].name is None
    assert got[2].winner == got[3].winner != got[1].winner and got[4].winner is None and got[5].winner == "" and got[6].name == "Otra"
    assert privacy.plaintext_ids(out).count() == 0 and privacy.plaintext_ids(spark.createDataFrame(rows, "winner string, name string")).count() == 3


def test_discard_reasons_in_order(spark):
    rows = [
        ("1", "x", 9, 9, True, True),
        ("U1", "x", 9, 9, True, False),
        ("A1", "Obras U.T.E. Norte", 9, 9, True, False),
        ("A2", "COMPUTER SA", 9, 9, True, False),
        ("A3", "x", 9, 9, False, False),
        ("A4", "x", 7, 7, True, False),
        ("A5", "x", 10, 5, True, False),
        ("A6", "x", 10, 6, True, False),
    ]
    df = spark.createDataFrame(rows, "winner string, name string, awards long, it_awards long, always_sme boolean, person boolean")
    assert [r.reason for r in cohort.discarded(df, F.col("person")).collect()] == [
        "natural person",
        "joint venture",
        "joint venture",
        None,
        "not always an SME",
        "too few awards",
        "not mostly IT",
        None,
    ]


def test_draws_do_not_depend_on_row_order(spark):
    rows = [(f"A{i}",) for i in range(30)]
    draw = lambda r: sorted(map(tuple, cohort.draw_companies(spark.createDataFrame(r, "winner string").repartition(4), "s").collect()))
    assert draw(rows) == draw(rows[::-1]) and [x[1] for x in sorted(draw(rows), key=lambda x: x[2])] == ["desarrollo"] * 2 + ["test"] * 5


def test_a_draw_needs_three_test_companies(spark):
    few = lambda n: cohort.draw_companies(spark.createDataFrame([(f"A{i}",) for i in range(n)], "winner string"), "s")
    assert few(5).count() == 5
    for n in (0, 2, 4):
        with pytest.raises(Exception, match=f"fewer than 3 test companies: {max(0, n - 2)}"):
            few(n).collect()


@pytest.mark.parametrize("kind", ["few", "ties", "spread", "one", "empty"])
def test_order_statistics_equal_sorting(spark, kind):
    import random

    import numpy as np
    from tenderlens.functions.order_statistics import order_statistics, percentile

    rng = random.Random(kind)
    values = {
        "few": [3, 1, 2, None], "ties": [rng.choice([1.5, 2.5, 2.5, 9.0]) for _ in range(301)], "one": [7.0], "empty": [],
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12) for _ in range(5000)],
    }[kind]
    df = spark.createDataFrame([(None if x is None else float(x), 5 - i % 3) for i, x in enumerate(values)], "x double, y int")
    p90 = F.greatest(F.lit(1), F.floor(F.col("n") * 0.9)) - 1
    got = order_statistics(df, {"median": ("x", percentile(0.5)), "p97": ("x", percentile(0.97)), "element": ("x", p90), "y": ("y", percentile(0.1))})
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    row, known = got.first(), sorted(x for x in values if x is not None)
    if not known:
        assert row.asDict() == {"median": None, "p97": None, "element": None, "y": None}
        return
    assert row.median == pytest.approx(float(np.quantile(known, 0.5)), rel=1e-12) and row.p97 == pytest.approx(float(np.quantile(known, 0.97)), rel=1e-12)
    assert row.element == known[max(1, int(0.9 * len(known))) - 1]


def test_rivals_share_their_draws_and_filters_for_all_count(spark):
    rows = [("A", f"e{i}", i % 2, int(i % 3 == 0), 1) for i in range(40)] + [("B", f"e{i}", 1, 1, 0) for i in range(7)]
    df = spark.createDataFrame(rows, "alias string, entry_id string, agent int, r1 int, r2 int")
    both = {(r.alias, r.rival): r[2:] for r in metrics.paired_bootstraps(df, "agent", ["r1", "r2"], "s", resamples=200).collect()}
    for rival in ("r1", "r2"):
        for r in metrics.paired_bootstrap(df, "agent", rival, "s", resamples=200).collect():
            assert both[r.alias, rival] == r[1:]
    won = spark.createDataFrame([("A", "e1"), ("A", "e2"), ("B", "e1")], "alias string, entry_id string")
    triaged = won.withColumn("decision", F.lit("si"))
    passing = spark.createDataFrame([("A", None, "e1"), ("B", "A", "e2")], "variant string, alias string, entry_id string")
    found = metrics.paired_indicators(won, triaged, passing, ["A", "B"]).collect()
    assert sorted((r.alias, r.entry_id, r.A, r.B) for r in found) == [("A", "e1", 1, 0), ("A", "e2", 0, 1), ("B", "e1", 1, 0)]


def test_attempts_of_readings(spark):
    calls = spark.createDataFrame([("d1", 1, 1), ("d1", 1, 2), ("d1", 2, 1), ("d2", 1, 1)], "doc_id string, reading_pass int, attempt int")
    assert {r.doc_id: r.attempts for r in evidence.attempts(calls).collect()} == {"d1": 3, "d2": 1}
    verified = spark.createDataFrame([("d1", "no page"), ("d2", None)], "doc_id string, rejected string")
    unreadable = spark.createDataFrame([("d3",)], "doc_id string")
    assert sorted(r.doc_id for r in evidence.second_attempts(verified, unreadable).collect()) == ["d1", "d3"]


def test_quotes_of_one_page_share_its_normalised_text(spark):
    quotes = spark.createDataFrame([("d", "1", "volumen_negocios", f"cita larga número {i}") for i in range(5)], "doc_id string, page string, kind string, quote string")
    text = spark.createDataFrame([("d", 1, "  cita \n larga  número 3 "), ("d", 2, "otra")], "doc_id string, page_no int, text string")
    out = evidence.verify_quotes(quotes, text, text, compatibility=False)
    assert [r.quote[-1] for r in out.collect() if r.rejected is None] == ["3"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join LeftOuter")
    assert "__text" in above and "text#" not in above.replace("__text#", "") and below


def pages(spark, *texts):
    return spark.createDataFrame(
        [("d", i, t + " " + "relleno " * 8 if t is not None else "") for i, t in enumerate(texts, 1)],
        "doc_id string, page_no int, text string",
    )


def test_window_around_the_best_page(spark):
    p = pages(
        spark,
        "Índice ..... 1 ..... 2 ..... 3 Solvencia económica",
        "técnica",
        "técnica",
        "nada",
        "Solvencia ECONÓMICA: volumen anual de negocios de 100.000 €",
        "nada",
    )
    assert [r.page_no for r in evidence.anchor_window(evidence.score_pages(p)).collect()] == [5]
    assert [(r.page_no, r.route) for r in evidence.locate(p).collect()] == [(5, "solvencia")]
    assert [(r.page_no, r.route) for r in evidence.locate(pages(spark, "nada", "Cuadro resumen del contrato")).collect()] == [(2, "anexos")]
    assert [(r.page_no, r.route) for r in evidence.locate(pages(spark, "nada", "nada")).collect()] == [(None, "no_localizada")]
    assert [r.route for r in evidence.locate(pages(spark, None)).collect()] == ["no_localizada: sin texto"]


def test_annex_pages_need_a_figure(spark):
    p = pages(spark, "véase el Anexo Nº 1", "Anexo nº. 1 Volumen", "ANEXO 1: volumen anual de negocios 300.000 euros")
    annex = spark.createDataFrame([("d", "1")], "doc_id string, annex string")
    none = p.where("false")
    assert [r.page_no for r in evidence.locate_annex(p, annex, none).collect()] == [3]
    assert evidence.locate_annex(p.where("page_no < 3"), annex, none).collect() == []
    quotes = [("d", "remite", "según el Anexo N. 1"), ("d", "remite", "anexo 1"), ("e", "remite", "ANEXO III"), ("f", "remite", "nada")]
    assert {r.doc_id: r.annex for r in evidence.cited_annex(spark.createDataFrame(quotes, "doc_id string, kind string, quote string")).collect()} == {"d": "1", "e": "III"}


def test_quotes_must_stand_on_the_page_sent(spark):
    p = spark.createDataFrame([("d", 1, "El «volumen»  anual – mínimo es de 100.000 €"), ("d", 2, "otra página")], "doc_id string, page_no int, text string")
    cases = [
        ("volumen_negocios", "1", "volumen» anual - mínimo es"),
        ("otra_cosa", "1", "volumen» anual"),
        ("remite", "dos", "volumen» anual"),
        ("remite", "2", "otra página"),
        ("remite", "1", "volumen"),
        ("remite", "1", "v" * 401),
        ("remite", "1", "volumen anual mínimo es"),
    ]
    reqs = spark.createDataFrame([("d", k, n, q) for k, n, q in cases], "doc_id string, kind string, page string, quote string")
    out = {(r.kind, r.page, r.quote): r.rejected for r in evidence.verify_quotes(reqs, p.where("page_no = 1"), p).collect()}
    assert [out[c] for c in cases] == [None, "unknown type", "no page", "page not sent", "quote too short", "quote too long", "quote not on page"]
    assert spark.range(1).select(normalise_quote(F.lit("ﬁn­‑“x”  y")).alias("q")).first().q == 'fin-"x" y'


def test_answers_bare_fenced_and_in_prose(spark):
    good = '{"decisiones":[{"ref":1,"decision":"sí","motivo":"a"},{"ref":1,"decision":"no","motivo":"b"},{"ref":2,"decision":"quizá"},{"ref":9,"decision":"duda","motivo":"c"}]}'
    bodies = [("x", good), ("y", f"```json\n{good}\n```"), ("z", f"Aquí: {good} fin"), ("w", "nada {")]
    responses = spark.createDataFrame(bodies, "call_id string, body string")
    parsed = triage.parse_decisions(responses)
    for c in "xyz":
        assert {(r.ref, r.decision, r.reason) for r in parsed.where(F.col("call_id") == c).collect()} == {(1, "si", "a"), (9, "duda", "c")}
    expected = spark.createDataFrame([("A", i, c, i) for c in "xw" for i in (1, 2)], "alias string, entry_id long, call_id string, ref long")
    assert sorted((r.call_id, r.ref, r.decision) for r in triage.triage_rows(expected, parsed).collect()) == [
        ("w", 1, "revisar"),
        ("w", 2, "revisar"),
        ("x", 1, "si"),
        ("x", 2, "revisar"),
    ]
    health = {r.call_id: (r.missing, r.invented, r.unreadable) for r in triage.triage_health(expected, responses, parsed.where("call_id in ('x', 'w')")).collect()}
    assert health == {"x": (1, 1, False), "w": (2, 0, True)}


REQ = "alias string, entry_id long, kind string, demand string, quote string, page int, amount double"


def test_rules_disqualify_on_turnover_only(spark):
    companies = spark.createDataFrame([("A", 500.0, "r", "ISO 9001 y ENS")], "alias string, turnover double, turnover_source string, profile string")
    rows = [
        ("A", 1, "volumen_negocios", "", "", 1, 600.0),
        ("A", 2, "volumen_negocios", "", "", 1, 400.0),
        ("A", 3, "certificaciones", "iso/iec 9001", "", 1, None),
        ("A", 4, "certificaciones", "ISO 27001", "", 1, None),
        ("A", 5, "no_se_exige", "", "", 1, None),
        ("A", 5, "volumen_negocios", "", "", 1, None),
        ("A", 6, "raro", "", "", 1, None),
    ]
    judged = rules.evaluate_requirements(spark.createDataFrame(rows, REQ), companies)
    pairs = spark.createDataFrame([("A", i) for i in range(1, 7)], "alias string, entry_id long")
    assert {r.entry_id: r.verdict for r in rules.verdict(pairs, judged).collect()} == {
        1: "no_apta",
        2: "apta",
        3: "apta",
        4: "revisar",
        5: "revisar",
        6: "revisar",
    }


def test_client_forms(spark):
    form = [("Empresa A", "a@b.es", "x" * 30, "850.000", "1,00"), ("", "mal", "corto", "nada", "21"), ("B!", "a@b.es", "x" * 30, "", "-1")]
    df = spark.createDataFrame(form, "alias string, correo string, que_hace string, cifra_negocio string, tope_diario_eur string")
    got = [r.errors for r in rules.validate_clients(df).collect()]
    assert got[0] == {} and set(got[1]) == {
        "alias",
        "correo",
        "que_hace",
        "cifra_negocio",
        "tope_diario_eur",
    } and got[2] == {"alias": "not a name", "tope_diario_eur": "negative"}
    table = lambda t: spark.range(1).select(rules.turnover_from_profile(F.lit(f"| Cifra anual de negocio | {t} |")).alias("v")).first().v
    assert table("Entre 600.000 € y 1.500.000 €") == 600000 and table("No publicada") is None


def test_triage_metrics(spark):
    t = spark.createDataFrame(
        [("A", "t1", "duda", 1), ("A", "t2", "no", 1), ("A", "t3", "si", 1), ("A", "t4", "no", 1)],
        "alias string, entry_id string, decision string, call_id long",
    )
    won = spark.createDataFrame([("A", "t1"), ("A", "t2"), ("A", "never triaged")], "alias string, entry_id string")
    assert metrics.triage_recall(won, t).first().value == 0.5
    universe = spark.createDataFrame([(4, 2)], "dossiers long, days long")
    assert metrics.triage_volume(t, won, universe).first().value == 1.0
    calls = spark.createDataFrame([(1, 0.10)], "call_id long, cost double")
    row = metrics.triage_cost(t, calls).first()
    assert (row.per_100, row.calls) == (2.5, 1)


def test_efficiency(spark):
    rows = spark.createDataFrame([(10.0, 0.5, 10.0), (10.0, 0.0, 10.0)], "volume double, recall double, contracts double")
    assert [r.reviews_per_hit for r in metrics.work_per_hit(rows).collect()] == [10 * 181 / 5, None]
    equal = spark.createDataFrame([(0.9, 100.0, 300.0), (0.8, 100.0, 10.0)], "rival_recall double, agent_volume double, rival_volume double")
    assert [r.equal_volume_recall for r in metrics.recall_at_equal_volume(equal).collect()] == [0.3, 0.8]


@pytest.mark.parametrize(("pairs", "check"), [
    ([(1, 1)] * 12 + [(0, 0)] * 8, lambda r: (r.low, r.high) == (0.0, 0.0)),
    ([(1, 0)] * 20, lambda r: r.low == r.high == 1.0),
    ([(1, 1)] * 9 + [(1, 0)], lambda r: r.difference == 0.1 and r.low == 0.0),
    ([(1, 0)] * 10 + [(0, 1)] * 10, lambda r: r.low < 0 < r.high),
])
def test_paired_bootstrap(spark, pairs, check):
    df = spark.createDataFrame([("A", f"e{i:02}", a, b) for i, (a, b) in enumerate(pairs)], "alias string, entry_id string, agent int, rival int")
    row = metrics.paired_bootstrap(df, "agent", "rival", "s", resamples=300).first()
    assert check(row), row
    assert row == metrics.paired_bootstrap(df.repartition(5), "agent", "rival", "s", resamples=300).first()


def test_budget_stops_at_the_first_failure(spark):
    queue = spark.createDataFrame([("A", i, c) for i, c in enumerate((0.02, 0.04, 0.30, 0.0), 1)], "alias string, place int, cost double")
    runs = lambda **o: [r.runs for r in queues.budget_cut(queue, "cost", F.lit(0.06), F.lit(0.01), **o).orderBy("place").collect()]
    assert runs() == [True, True, False, False] and runs(reserve=F.lit(0.03)) == [True, True, False, False]
    assert [spark.range(1).select(queues.affordable_docs(F.lit(a), F.lit(b)).alias("n")).first().n for a, b in ((1.0, 0.15), (-1.0, 0.15), (1.0, 0.0))] == [6, 0, 0]


def test_costs(spark):
    prices = spark.createDataFrame([("m", 5.0, 25.0)], "model string, price_in double, price_out double")
    calls = spark.createDataFrame(
        [("m", 1000, 100, 200, 50, False, 1.0), ("m", 1000, 100, 200, 50, True, 1.0), ("x", 1, 1, 1, 1, False, 1.0)],
        "model string, tokens_in long, cache_write long, cache_read long, tokens_out long, batch boolean, fx double",
    )
    out = costs.call_cost(calls, prices).collect()
    full = (1000 * 5 + 100 * 5 * 1.25 + 200 * 5 * 0.1 + 50 * 25) / 1e6
    got = sorted((r.cost for r in out if r.error is None), reverse=True)
    assert got == pytest.approx([full, full / 2], abs=1e-6) and sum(r.error == "unknown model" for r in out) == 1
    late = spark.createDataFrame([(1, day("2026-09-28 22:30:00"), 0.5)], "call_id long, called_at timestamp, cost double")
    assert costs.spend_by_day(late).first().day == dt.date(2026, 9, 29)
    reqs = spark.createDataFrame([("d", 1), ("d", 1), ("e", 2), ("f", 3)], "doc_id string, call_id long")
    spent = spark.createDataFrame([(1, 0.02), (2, 0.04), (3, 0.30)], "call_id long, cost double")
    assert 0.04 < costs.reading_reserve(reqs, spent).first().reserve <= 0.30
    assert costs.reading_reserve(reqs.where("false"), spent).first().reserve == 0.15


def test_checks(spark):
    profiles = spark.createDataFrame([("A", "texto", None), ("B", "texto", "x")], "alias string, text string, sha256 string").withColumn(
        "sha256",
        F.when(F.col("alias") == "B", F.col("sha256")).otherwise(F.sha2("text", 256)),
    )
    assert [r.alias for r in checks.changed_profiles(profiles).collect()] == ["B"]
    runs = spark.createDataFrame(
        [(1, day("2025-01-01 00:00:00"), None, "x"), (2, day("2025-01-01 11:00:00"), None, "x")],
        "id int, started_at timestamp, ended_at timestamp, state string",
    )
    now = F.lit("2025-01-01 12:00:00").cast("timestamp")
    assert [r.id for r in checks.stale_runs(runs, now).collect()] == [1] and [r.state for r in checks.close_stale(runs, now).orderBy("id").collect()] == ["error", "x"]


def test_months(spark):
    months = lambda a, b: spark.range(1).select(versions.month_range(F.lit(a).cast("date"), F.lit(b).cast("date")).alias("m")).first().m
    assert months("2024-11-15", "2025-02-01") == ["2024-11", "2024-12", "2025-01", "2025-02"]
    with pytest.raises(Exception, match="first month"):
        months("2025-02-01", "2025-01-01")


def test_character_references_equal_the_standard_library(spark):
    import html
    import random
    from html.entities import html5

    from tenderlens.functions.markup import unescape

    bits = [
        "&amp;",
        "&#243;",
        "&ntilde;",
        "&#x41;",
        "&#x1F600;",
        "&#0;",
        "&#128;",
        "&#129;",
        "&#55296;",
        "&#1114112;",
        "&#9999999999999999999;",
        "&#x0;",
        "&notit;",
        "&not",
        "&copy",
    ]
    bits += [
        "& ",
        "&&",
        "&;",
        "&#;",
        "&#x;",
        "&#xg",
        "a",
        "ñ",
        "&Aacute",
        "&lt;b&gt;",
        "&amp;lt;",
        "&#13;",
        "&#11;",
        "&#65534;",
        "&#x1FFFF;",
        "&unknown;",
        "&#38;amp;",
        "&#00065;",
        "&ltx",
    ]
    rng = random.Random(1)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(800)] + [f"&{n}" for n in html5] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(F.col("t")).alias("u"))
    assert all(r.u == (None if r.t is None else html.unescape(r.t)) for r in rows.collect())
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_pages_with_cut_references_equal_their_sql(spark, tmp_path):
    """References without a final semicolon stay as they are in p10 and p6, as in their SQL."""
    import duckdb
    from tenderlens.plans import ORACLES, QUERIES

    texts = ["ver&amp</h1>&amp;&copy", "&#39 &#39; &quot&quot;", "&amp;copy; &am & &amp;amp;", "<p>a&lt b&middot;</p>"]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("p10_unescape_entities", "p6_solvency_text"):
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]}) x").fetchall())


def test_equal_example_quotes_give_the_first_page(spark):
    rows = [(1, p, "volumen_negocios", 5.0, "igual", None) for p in ("10", "9", "3", "11")]
    df = spark.createDataFrame(rows, "doc_id long, page string, kind string, amount double, quote string, rejected string").repartition(4, "page")
    assert [r.page for r in reports.example_requirement(df).collect()] == ["3"]


def test_vocabulary_without_rows_is_an_error(spark, tmp_path):
    from tenderlens.sources.reference_data import read_cpv_vocabulary

    (tmp_path / "v.gc").write_text(
        '<Row><Value ColumnRef="code"><SimpleValue>03000000</SimpleValue></Value><Value ColumnRef="nombre"><SimpleValue>Agricultura &amp; ma&iacute;z</SimpleValue></Value></Row>',
    )
    assert [tuple(r) for r in read_cpv_vocabulary(spark, str(tmp_path / "v.gc")).collect()] == [("03000000", "Agricultura & maíz")]
    (tmp_path / "none.gc").write_text("<CodeList/>")
    with pytest.raises(ValueError):
        read_cpv_vocabulary(spark, str(tmp_path / "none.gc"))


def test_go_gates_need_every_measure(spark):
    from tenderlens.operators import profile

    def gate(a, b, c):
        feed = spark.createDataFrame([(a, c)], "pct_awarded_with_id double, pct_without_figure double")
        return profile.go_gates(feed, spark.createDataFrame([(b,)], "pct_readable double")).first().gate

    assert [gate(80.0, 70.0, 50.0), gate(79.9, 70.0, 50.0), gate(80.0, None, 50.0), gate(80.0, 70.0, 49.9)] == ["GO", "REVISAR", "REVISAR", "REVISAR"]
