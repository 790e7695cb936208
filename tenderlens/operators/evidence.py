"""Finding the pages that hold requirements, following annexes, and checking quotes against pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNICODE, folded, normalise_quote, plain_words
from .profile import PATTERNS, found, is_text

WINDOW = 6
# Points of a page, and the kinds of requirement that weigh most.
POINTS = {"section": 3, "core": 2, "other": 1, "figure": 1, "index": -3}
CORE = ("volumen_negocios", "trabajos_similares", "clasificacion")
TYPES = ("volumen_negocios", "trabajos_similares", "certificaciones", "clasificacion", "habilitacion", "adscripcion", "remite", "no_se_exige")
LEADERS, LEAST_LEADERS = r"\.{5,}", 3
SHORTEST_QUOTE, LONGEST_QUOTE, MOST_REQUIREMENTS = 10, 400, 8
# How a clause cites an annex, and the leaders of an index page.
REFERENCE = r"anexo\s*n?[ºo°.]{0,3}\s*([IVXLC]+|\d{1,2})\b"


def page_score(patterns: dict = PATTERNS, low: str | None = None) -> Column:
    """What a page promises; an index page costs points, but no page goes below 0. Of a page's text, or where given also of its folded() column."""
    point = lambda hit, n: F.when(hit, n).otherwise(0)
    score = point(found("text", patterns["section"], low), POINTS["section"]) + point(found("text", patterns["figure"], low), POINTS["figure"])
    for kind, p in patterns["requirements"].items():
        score = score + point(found("text", p, low), POINTS["core"] if kind in CORE else POINTS["other"])
    return F.greatest(F.lit(0), score + point(F.regexp_count("text", F.lit(LEADERS)) >= LEAST_LEADERS, POINTS["index"]))


def low_column(patterns: dict) -> str | None:
    """The name of the folded() column; None where too few of the patterns are plain words for it to pay."""
    plain = [p for p in (patterns["section"], patterns["annexes"], *patterns["requirements"].values()) if plain_words(p)]
    return "__low" if len(plain) > 2 else None


def with_low(pages: DataFrame, low: str | None, text: Column) -> DataFrame:
    """pages with that column where they are text; it is a step of its own, so that all patterns share it."""
    return pages.withColumn(low, F.when(text, folded(F.col("text")))) if low else pages


def score_pages(pages: DataFrame, patterns: dict = PATTERNS) -> DataFrame:
    low = low_column(patterns)
    rows = with_low(pages.where(is_text()), low, F.lit(True)).withColumn("score", page_score(patterns, low))
    return rows.drop(low) if low else rows


def anchor_window(scores: DataFrame, cap: int = WINDOW) -> DataFrame:
    """Of text pages with scores: the best page (the first of equals) and those after it up to cap, without a tail of zeros."""
    doc = Window.partitionBy("doc_id")
    rows = scores.withColumn("__n", F.row_number().over(doc.orderBy("page_no")))
    best = F.max(F.struct("score", -F.col("__n"))).over(doc)
    rows = rows.withColumns({"__best": best["score"], "__at": -best["col2"]})
    rows = rows.where((F.col("__best") > 0) & (F.col("__n") >= F.col("__at")) & (F.col("__n") < F.col("__at") + cap))
    last = F.max(F.when(F.col("score") > 0, F.col("__n"))).over(doc)
    return rows.withColumn("__last", last).where("__n <= __last").drop("__n", "__best", "__at", "__last")


def locate(pages: DataFrame, patterns: dict = PATTERNS, cap: int = WINDOW) -> DataFrame:
    """(doc_id, page_no, score, route): the window by score, else by annexes, else one row without page that says why.

    One pass over the texts and one shuffle by document: what a document goes by is decided on its pages' scores.
    """
    doc = Window.partitionBy("doc_id")
    low = low_column(patterns)
    rows = with_low(pages.select("doc_id", "page_no", "text", is_text().alias("t")), low, F.col("t")).select(
        "doc_id",
        "page_no",
        "t",
        F.when(F.col("t"), page_score(patterns, low)).alias("s"),
        F.when(F.col("t") & found("text", patterns["annexes"], low), 1).otherwise(0).alias("a"),
    )
    rows = rows.withColumns({"main": F.coalesce(F.max("s").over(doc) > 0, F.lit(False)), "readable": F.bool_or("t").over(doc)})
    score = F.when(~F.col("t"), 0).when(F.col("main"), F.col("s")).otherwise(F.col("a"))
    rows = rows.withColumns({"score": score, "n": F.row_number().over(doc.orderBy(F.desc("t"), "page_no"))})
    best = F.max(F.struct("score", -F.col("n"))).over(doc)
    rows = rows.withColumns({"best": best["score"], "at": -best["col2"]})
    within = F.col("t") & (F.col("best") > 0) & (F.col("n") >= F.col("at")) & (F.col("n") < F.col("at") + cap)
    rows = rows.withColumn("in", within).withColumn("last", F.max(F.when(F.col("in") & (F.col("score") > 0), F.col("n"))).over(doc))
    none = F.col("best") <= 0
    rows = rows.where((F.col("in") & (F.col("n") <= F.col("last"))) | (none & (F.col("n") == 1)))
    route = F.when(none & F.col("readable"), "no_localizada").when(none, "no_localizada: sin texto").when(F.col("main"), "solvencia").otherwise("anexos")
    return rows.select("doc_id", F.when(~none, F.col("page_no")).cast("int").alias("page_no"), "score", route.alias("route"))


def requirement_hints(pages: DataFrame, patterns: dict = PATTERNS) -> DataFrame:
    """Per document the first text page of each kind of requirement."""
    text = pages.where(is_text())
    return text.groupBy("doc_id").agg(*(F.min(F.when(found("text", p), F.col("page_no"))).alias(f"first_{k}") for k, p in patterns["requirements"].items()))


def cited_annex(requirements: DataFrame, pattern: str = REFERENCE) -> DataFrame:
    """(doc_id, annex): the annex that `remite` quotes cite most; of equals the smallest."""
    cited = requirements.where("kind = 'remite'").select("doc_id", F.explode(F.regexp_extract_all("quote", F.lit(UNICODE + pattern), 1)).alias("annex"))
    counts = cited.groupBy("doc_id", F.upper("annex").alias("annex")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.min_by("annex", F.struct(-F.col("n"), F.col("annex"))).alias("annex"))


def needs_annex_hop(readings: DataFrame) -> DataFrame:
    """(doc_id, hop): some `remite`, no amount, and no hop made yet."""
    return readings.groupBy("doc_id").agg((F.bool_or(F.col("kind") == "remite") & ~F.bool_or(F.col("amount").isNotNull()) & (F.max("hops") < 1)).alias("hop"))


def locate_annex(pages: DataFrame, annexes: DataFrame, read: DataFrame, patterns: dict = PATTERNS, word: str = "anexo", cap: int = WINDOW) -> DataFrame:
    """(doc_id, page_no, score): among text pages not read, those that name the annex and hold a figure; nothing if it is in another file."""
    rows = pages.where(is_text()).join(annexes, "doc_id").join(read.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    named = F.regexp_like("text", F.concat(F.lit(UNICODE + word + r"\s*n?[ºo°.]{0,3}\s*"), F.col("annex"), F.lit(r"\b")))
    scored = rows.select(
        "doc_id",
        "page_no",
        F.when(named & found("text", patterns["figure"]), page_score(patterns) + POINTS["section"]).otherwise(0).alias("score"),
    )
    return anchor_window(scored, cap)


def pages_to_prompt(pages: DataFrame, located: DataFrame) -> DataFrame:
    """(doc_id, prompt): the located pages' texts in order, each under its number."""
    rows = located.where("page_no is not null").select("doc_id", "page_no").join(pages, ["doc_id", "page_no"])
    shown = F.concat(F.lit("=== Página "), F.col("page_no").cast("string"), F.lit(" ===\n"), F.trim("text"))
    return rows.groupBy("doc_id").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("page_no", shown.alias("t")))), lambda x: x["t"]),
        "\n\n",
    ).alias("prompt"))


def verify_quotes(requirements: DataFrame, sent: DataFrame, pages: DataFrame, types: tuple[str, ...] = TYPES, compatibility: bool = True) -> DataFrame:
    """requirements with `rejected`: the first reason a quote proves nothing, null if it stands. Rejected rows stay.

    Pages are normalised before they meet their quotes: once each, however many quotes they have.
    """
    rows = requirements.withColumn("__page", F.col("page").try_cast("int"))
    keys = [rows["doc_id"] == F.col("__d"), rows["__page"] == F.col("__p")]
    given = sent.select(F.col("doc_id").alias("__d"), F.col("page_no").alias("__p")).distinct()
    quoted = rows.select(F.col("doc_id").alias("__d"), F.col("__page").alias("__p")).distinct()  # other pages need no normalising
    texts = pages.select(F.col("doc_id").alias("__d"), F.col("page_no").alias("__p"), "text").join(given.join(quoted, ["__d", "__p"]), ["__d", "__p"])
    texts = texts.select("__d", "__p", normalise_quote(F.col("text"), compatibility).alias("__text"))
    quote = normalise_quote(F.col("quote"), compatibility)
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*types), F.lit(False)), "unknown type")
        .when(F.col("__page").isNull(), "no page")
        .when(F.col("__text").isNull(), "page not sent")
        .when(F.length(quote) < SHORTEST_QUOTE, "quote too short")
        .when(F.length("quote") > LONGEST_QUOTE, "quote too long")
        .when(~F.col("__text").contains(quote), "quote not on page")
    )
    return rows.join(texts, keys, "left").withColumn("rejected", reason).drop("__d", "__p", "__page", "__text")


def json_object(body: Column) -> Column:
    """The first text that can be a JSON object: the whole answer, a fenced part, or from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract_all(body, F.lit(r"(?s)```(?:json)?\s*(.+?)```"), 1)
    outer = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    candidates = F.concat(F.array(F.trim(body)), F.transform(fenced, lambda x: F.trim(x)), F.array(outer))
    good = F.filter(candidates, lambda c: F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull())
    return F.try_element_at(good, F.lit(1))


REQUIREMENT = "array<struct<tipo: string, exigencia: string, cita: string, pagina: string, importe_eur: string, anios: string>>"


def parse_extractions(responses: DataFrame) -> DataFrame:
    """(response keys, position, kind, demand, quote, page, amount, years), at most eight per response; an unreadable one gives one row without position."""
    parsed = responses.withColumn("__r", F.from_json(json_object(F.col("body")), f"requisitos {REQUIREMENT}")["requisitos"])
    keys = [c for c in responses.columns if c != "body"]
    rows = parsed.select(*keys, F.col("__r").isNull().alias("unreadable"), F.posexplode_outer(F.slice("__r", 1, MOST_REQUIREMENTS)).alias("position", "r"))
    positive = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    return rows.select(
        *keys,
        "unreadable",
        "position",
        F.col("r.tipo").alias("kind"),
        F.substring(F.trim("r.exigencia"), 1, 500).alias("demand"),
        F.trim("r.cita").alias("quote"),
        F.col("r.pagina").alias("page"),
        positive(F.col("r.importe_eur")).alias("amount"),
        F.floor(positive(F.col("r.anios"))).cast("int").alias("years"),
    )


def retry_message(rejected: DataFrame) -> DataFrame:
    """(doc_id, message): every rejection of a first attempt, for the second."""
    line = F.concat(F.lit("- "), F.col("rejected"), F.lit(": «"), F.substring(F.coalesce("quote", F.lit("")), 1, 120), F.lit("»"))
    rows = rejected.where("rejected is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return rows.select("doc_id", F.concat(F.lit("Requisitos rechazados:\n"), F.col("lines")).alias("message"))


MOST_ATTEMPTS = 2


def attempts(responses: DataFrame) -> DataFrame:
    """(doc_id, attempts): calls of a document's readings (doc_id, reading_pass, attempt), the second pass's on top of the first's."""
    return responses.groupBy("doc_id", "reading_pass").agg(F.max("attempt").alias("n")).groupBy("doc_id").agg(F.sum("n").cast("int").alias("attempts"))


def second_attempts(verified: DataFrame, unreadable: DataFrame) -> DataFrame:
    """(doc_id): documents whose first answer is asked for again: unreadable ones, and those with a rejected quote."""
    return unreadable.select("doc_id").union(verified.where("rejected is not null").select("doc_id")).distinct()


def reading_state() -> Column:
    """The state of a reading, of its route before any hop and its number of requirements."""
    unread = F.when(F.col("route").startswith("no_localizada: "), "ilegible").when(F.col("route").startswith("no_localizada"), "sin_localizar")
    return unread.when(F.col("total") == 0, "ilegible_respuesta").otherwise("leido")


def counts_of(verified: DataFrame) -> DataFrame:
    return verified.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rejected").isNull()).alias("verified"))


def reading_states(located: DataFrame, verified: DataFrame) -> DataFrame:
    """(doc_id, state) as reading_rows() has them: neither annexes nor calls have a say in it, so these need not be found."""
    routes = located.groupBy("doc_id").agg(F.min("route").alias("route"))
    return routes.join(counts_of(verified), "doc_id", "left").na.fill(0, ["total"]).select("doc_id", reading_state().alias("state"))


def reading_rows(located: DataFrame, verified: DataFrame, hopped: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Per document: route (+anexo after a hop), pages read, state, how many requirements stand, and with attempts() of its calls (0 where none was made) their number."""
    pages = located.groupBy("doc_id").agg(F.min("route").alias("route"), F.array_sort(F.collect_set("page_no")).alias("pages"))
    more = hopped.groupBy("doc_id").agg(F.collect_set("page_no").alias("more"))
    rows = pages.join(more, "doc_id", "left").join(counts_of(verified), "doc_id", "left").na.fill(0, ["total", "verified"])
    if tried is not None:
        rows = rows.join(tried.select("doc_id", "attempts"), "doc_id", "left").na.fill(0, ["attempts"])
    return rows.select(
        "doc_id",
        *(["attempts"] if tried is not None else []),
        F.when(F.col("more").isNotNull(), F.concat("route", F.lit("+anexo"))).otherwise(F.col("route")).alias("route"),
        F.array_sort(F.array_union("pages", F.coalesce("more", F.array().cast("array<int>")))).alias("pages"),
        reading_state().alias("state"),
        "total",
        "verified",
    )


def both_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Requirements of two reading passes, those of the first before those of the annex, with the number of their pass."""
    return first.withColumn("reading_pass", F.lit(1)).unionByName(second.withColumn("reading_pass", F.lit(2)))


def replace_readings(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Requirements after documents were read again: what a fresh reading says replaces all that was stored of its document."""
    return stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)
