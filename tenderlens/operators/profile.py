"""Measures of the feed and of document texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order_statistics import order_statistics, percentile
from ..functions.text import UNICODE, plain_words
from .versions import as_published

# What tells the kinds of requirement, the section, figures, deferrals and check boxes in Spanish tender documents.
REQUIREMENTS = {
    "volumen_negocios": r"volumen anual de negocios|cifra (?:anual )?de negocios",
    "trabajos_similares": r"anual acumulado|principales servicios|trabajos realizados de igual",
    "certificaciones": r"ISO\s?\d{4,5}|Esquema Nacional de Seguridad|EMAS|PCI[- ]?DSS",
    "clasificacion": r"clasificaci[oó]n empresarial|grupo\s+[A-Z]\s*,?\s*subgrupo",
    "habilitacion": r"habilitaci[oó]n empresarial|habilitaci[oó]n profesional",
    "adscripcion": r"adscribir a la ejecuci[oó]n|adscripci[oó]n de medios",
}
SECTION = r"solvencia econ[oó]mica|capacidad y solvencia|volumen anual de negocios"
FIGURE = r"\d[\d.\s]{2,}(?:,\d+)?\s*(?:€|euros)"
DEFERS = r"anexo\s+[IVX0-9]|anuncio de licitaci[oó]n|cuadro (?:de caracter|resumen)"
BOXES = r"[☐☑☒█]"
ANNEXES = r"cuadro (?:de caracter[ií]sticas|resumen)|anexo\s+[IVX0-9]+|requisitos de (?:capacidad|participaci[oó]n|solvencia)"
LEAST_TEXT = 50

PATTERNS = {"requirements": REQUIREMENTS, "section": SECTION, "figure": FIGURE, "defers": DEFERS, "boxes": BOXES, "annexes": ANNEXES}


def found(text: str, pattern: str, low: str | None = None) -> Column:
    """Whether the pattern is in the text; with its folded() column, plain words are searched there, which is the same and takes less time."""
    words = plain_words(pattern) if low else []
    return reduce(lambda a, b: a | b, (F.col(low).contains(w) for w in words)) if words else F.col(text).rlike(UNICODE + pattern)


def is_text(text: str = "text", least: int = LEAST_TEXT) -> Column:
    """Whether a page holds more than that many characters besides outer white space."""
    # From the first character that is no white space on, the search ends at the next one far enough from it.
    return F.col(text).rlike(rf"(?Us)\A\s*+\S.{{{least - 1},}}?\S" if least else r"(?U)\S")


def universe(notices: DataFrame, first: str, last: str) -> DataFrame:
    """One row: dossiers first published in the period, on how many days (at least 1)."""
    rows = as_published(notices, first, last)
    return rows.agg(F.count(F.lit(1)).alias("dossiers"), F.greatest(F.lit(1), F.count_distinct(F.to_date("entry_updated"))).cast("long").alias("days"))


def month_totals(staging: DataFrame, notices: DataFrame, awards: DataFrame) -> DataFrame:
    """Per month: entries, notices and awards that are present; joins multiply as counted."""
    n = notices.groupBy("entry_id", "entry_updated").agg(F.count(F.lit(1)).alias("n"))
    a = awards.groupBy("entry_id", "entry_updated").agg(F.count(F.lit(1)).alias("a"))
    keys = ["entry_id", "entry_updated"]
    rows = staging.join(n, keys, "left").join(a, keys, "left")
    return rows.groupBy("month").agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("notices"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("awards"),
    )


def rate(part: Column, whole: Column) -> Column:
    """Per cent with two digits; null where the whole is 0."""
    return F.round(F.try_divide(100.0 * part, whole), 2)


def feed_profile(notices: DataFrame, published: str, awarded: Column, it: Column) -> DataFrame:
    """One row of measures of a feed sample (entry_id, entry_updated, state, winner, solvency and its flags, pcap, lots).

    Rates are per cent, null where there is nothing to divide by; days run from the first to the last one.
    """
    n = F.count(F.lit(1))
    first, last = F.min(F.to_date("entry_updated")), F.max(F.to_date("entry_updated"))
    days = F.greatest(F.coalesce(F.datediff(last, first), F.lit(0)) + 1, F.lit(1))
    per_day = lambda c: F.round(c / days, 2)
    is_new = F.col("state") == published
    new, new_it = F.count_distinct(F.when(is_new, F.col("entry_id"))), F.count_distinct(F.when(is_new & it, F.col("entry_id")))
    with_text, figure = F.count_if(F.col("solvency").isNotNull()), F.count_if(F.col("solvency").isNotNull() & F.col("with_figure"))
    defers = F.count_if(F.col("solvency").isNotNull() & F.col("defers"))
    return notices.agg(
        n.alias("entries"),
        first.alias("first_day"),
        last.alias("last_day"),
        days.cast("long").alias("days"),
        F.count_distinct("entry_id").alias("dossiers"),
        F.count_distinct("state").alias("states"),
        per_day(n).alias("entries_per_day"),
        new.alias("new_dossiers"),
        per_day(new).alias("new_per_day"),
        F.count_if(it).alias("it"),
        rate(F.count_if(it), n).alias("pct_it"),
        per_day(F.count_if(it)).alias("it_per_day"),
        per_day(new_it).alias("new_it_per_day"),
        rate(F.count_if(F.col("pcap").isNotNull()), n).alias("pct_pcap"),
        F.count_if(awarded).alias("awarded"),
        rate(F.count_if(awarded & F.col("winner").isNotNull()), F.count_if(awarded)).alias("pct_awarded_with_id"),
        rate(with_text, n).alias("pct_with_solvency"),
        rate(figure, with_text).alias("pct_with_figure"),
        rate(defers, with_text).alias("pct_defers"),
        rate(n - figure, n).alias("pct_without_figure"),
        rate(F.count_if(F.col("lots") > 0), n).alias("pct_with_lots"),
    )


def feed_states(notices: DataFrame) -> DataFrame:
    """(state, entries), most frequent first."""
    return notices.groupBy("state").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "state")


def download_rate(docs: DataFrame) -> DataFrame:
    """One row: documents that were tried, and the share of them that can be read."""
    tried = F.count_if(F.col("state") != "pendiente")
    return docs.agg(tried.alias("tried"), rate(F.count_if(F.col("state") == "descargado"), tried).alias("pct_readable"))


def document_profile(pages: DataFrame, patterns: dict = PATTERNS, least: int = LEAST_TEXT) -> DataFrame:
    """Per document: pages, text pages, scanned, characters, first page of each requirement, section page, what stands near it, boxes, pages to read."""
    kinds = patterns["requirements"]
    n, with_text = F.count(F.lit(1)), F.count_if(is_text(least=least))
    measured = pages.groupBy("doc_id").agg(
        n.alias("pages"),
        with_text.alias("text_pages"),
        (F.sum(F.length("text")) + n - 1).alias("chars"),
        *(F.min(F.when(found("text", p), F.col("page_no"))).alias(f"first_{k}") for k, p in kinds.items()),
        F.min(F.when(found("text", patterns["section"]), F.col("page_no"))).alias("section_page"),
        F.sum(F.regexp_count("text", F.lit(patterns["boxes"]))).alias("boxes"),
    )
    near = pages.join(
        measured.where("section_page is not null").select("doc_id", "section_page"),
        "doc_id",
    ).where("page_no between section_page and section_page + 2")
    near = near.groupBy("doc_id").agg(
        F.bool_or(found("text", patterns["figure"])).alias("figure_near"),
        F.bool_or(found("text", patterns["defers"])).alias("defers_near"),
    )
    firsts = F.array(*(F.col(f"first_{k}") for k in kinds))
    distinct = F.size(F.array_distinct(F.filter(firsts, lambda x: x.isNotNull())))
    return measured.join(near, "doc_id", "left").withColumns(
        {
            "scanned": F.col("text_pages") < F.greatest(F.lit(1), F.floor(F.col("pages") / 2)),
            "figure_near": F.coalesce("figure_near", F.lit(False)),
            "defers_near": F.coalesce("defers_near", F.lit(False)),
            "form": F.col("boxes") > 10,
            "pages_to_read": F.when(distinct > 0, distinct).otherwise(F.col("section_page").isNotNull().cast("int")),
        }
    )


def corpus_profile(profiles: DataFrame) -> DataFrame:
    """One row over document profiles; p90 of pages is the element int(0.9 n) - 1 of the sorted list."""
    n = F.count(F.lit(1))
    whole = profiles.agg(
        n.alias("documents"),
        F.max("pages").alias("pages_max"),
        rate(F.count_if("scanned"), n).alias("pct_scanned"),
        rate(F.count_if("form"), n).alias("pct_forms"),
        rate(F.count_if(F.col("section_page").isNotNull()), n).alias("pct_located"),
        rate(F.count_if("figure_near"), n).alias("pct_figure"),
        rate(F.count_if("defers_near"), n).alias("pct_defers"),
    )
    medians = {f"{name}_median": (c, percentile(0.5)) for name, c in (("pages", "pages"), ("to_read", "pages_to_read"), ("chars", "chars"))}
    p90 = F.greatest(F.lit(1), F.floor(F.col("n") * 0.9)) - 1
    placed = order_statistics(profiles, medians | {"pages_p90": ("pages", p90)}).withColumn("pages_p90", F.col("pages_p90").cast("long"))
    return whole.join(F.broadcast(placed))  # one row each


def requirement_frequency(profiles: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, documents, pct): how many documents name each kind of requirement."""
    rows = profiles.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"first_{k}").alias("page")) for k in kinds))).alias("r"))
    return rows.groupBy("r.kind").agg(F.count("r.page").alias("documents"), rate(F.count("r.page"), F.count(F.lit(1))).alias("pct"))


# Least per cent of awards that name their winner, of documents that can be read, and of entries without a figure.
GATES = {"pct_awarded_with_id": 80, "pct_readable": 70, "pct_without_figure": 50}


def go_gates(feed: DataFrame, downloads: DataFrame) -> DataFrame:
    """One row of feed_profile() and download_rate(): GO only if every measure reaches its gate; a measure that is null does not."""
    both = feed.join(F.broadcast(downloads))  # one row each
    ok = F.lit(True)
    for measure, least in GATES.items():
        ok = ok & (F.coalesce(measure, F.lit(0.0)) >= least)
    return both.select(F.when(ok, "GO").otherwise("REVISAR").alias("gate"), *GATES)


def catalog_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(item, n) for every named table; one small aggregate each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def dashboard_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, item, n) of versions, awards, docs, companies, triage, readings, requirements and cards: one aggregate a table."""
    one = F.lit(1)

    def counted(table: str, section: str, **items: Column) -> DataFrame:
        sums = tables[table].agg(*(c.alias(k) for k, c in items.items()))
        pairs = F.array(*(F.struct(F.lit(k.replace("_", " ")).alias("item"), F.col(k).cast("long").alias("n")) for k in items))
        return sums.select(F.lit(section).alias("section"), F.explode(pairs).alias("x")).select("section", "x.*")

    verdicts = tables["cards"].groupBy("verdict").agg(F.count(one).alias("n")).select(F.lit("cards").alias("section"), F.col("verdict").alias("item"), "n")
    parts = [
        counted("versions", "data", versions=F.count(one), dossiers=F.count_distinct("entry_id")),
        counted("awards", "data", awards=F.count(one)),
        counted("docs", "data", documents_downloaded=F.count_if(F.col("state") == "descargado")),
        counted("companies", "data", companies=F.count(one)),
        counted("triage", "triage", decisions=F.count(one), dossiers_seen=F.count_distinct("entry_id"), companies_served=F.count_distinct("alias")),
        counted("readings", "readings", documents_read=F.count_if(F.col("state") == "leido")),
        counted("requirements", "readings", requirements_verified=F.count_if(F.col("rejected").isNull()), requirements=F.count(one)),
    ]
    for part in parts:
        verdicts = verdicts.unionByName(part)
    return verdicts
