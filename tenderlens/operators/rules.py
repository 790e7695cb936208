"""Versioned eligibility rules and client forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNICODE, collapse, euros, spanish_number

VERSION = "v1"
# Outcomes of a requirement and verdicts of a card.
MET, UNMET, UNKNOWN = "cumple", "no_cumple", "no_se_puede_saber"
FIT, UNFIT, REVIEW = "apta", "no_apta", "revisar"
BY_HAND = {
    "trabajos_similares": "trabajos similares",
    "clasificacion": "clasificación",
    "habilitacion": "habilitación",
    "adscripcion": "medios adscritos",
    "remite": "otro documento",
}


def certifications(text: Column) -> Column:
    """Sorted distinct names of known certifications in a text."""
    text = F.coalesce(text, F.lit(""))
    iso = F.transform(F.regexp_extract_all(text, F.lit(UNICODE + r"ISO[\s/]*(?:IEC[\s/]*)?(\d{4,5})"), 1), lambda n: F.concat(F.lit("ISO "), n))
    named = F.array(*(F.when(text.rlike(UNICODE + p), F.lit(name)) for name, p in (
        ("ENS", r"Esquema Nacional de Seguridad|ENS"),
        ("EMAS", "EMAS"),
        ("PCI DSS", r"PCI[\s-]?DSS"),
    )))
    return F.array_sort(F.array_distinct(F.concat(iso, F.filter(named, lambda x: x.isNotNull()))))


def evaluate_requirements(requirements: DataFrame, companies: DataFrame) -> DataFrame:
    """requirements (alias, entry_id, kind, demand, quote, page, amount) of known kinds with `result` and `why`."""
    rows = requirements.join(companies.select("alias", "turnover", "turnover_source", "profile"), "alias", "left")
    asked = certifications(F.concat_ws(" ", "demand", "quote"))
    lacking = F.array_except(asked, certifications(F.col("profile")))
    volume = F.when(F.col("amount").isNull() | F.col("turnover").isNull(), UNKNOWN).when(F.col("turnover") >= F.col("amount"), MET).otherwise(UNMET)
    papers = F.when((F.size(asked) > 0) & (F.size(lacking) == 0), MET).otherwise(UNKNOWN)
    result = F.when(F.col("kind") == "volumen_negocios", volume).when(F.col("kind") == "certificaciones", papers).when(F.col("kind") == "no_se_exige", MET).when(F.col("kind").isin(*BY_HAND), UNKNOWN)
    by_hand = F.element_at(F.create_map(*(F.lit(x) for p in BY_HAND.items() for x in p)), F.col("kind"))
    why = (
        F.when(
            F.col("kind") == "volumen_negocios",
            F.concat(
                F.lit("volumen exigido: "),
                F.coalesce(euros(F.col("amount")), F.lit("sin cifra")),
                F.lit("; consta: "),
                F.coalesce(euros(F.col("turnover")), F.lit("sin cifra")),
            ),
        )
        .when(F.col("kind") == "certificaciones", F.concat(F.lit("exigidas: "), F.array_join(asked, ", "), F.lit("; faltan: "), F.array_join(lacking, ", ")))
        .when(F.col("kind") == "no_se_exige", F.lit("no se exige solvencia"))
        .otherwise(F.concat(F.lit("a mano: "), by_hand))
    )
    return rows.withColumns({"result": result, "why": why}).where("result is not null").drop("turnover", "turnover_source", "profile")


def verdict(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """(alias, entry_id, verdict, reasons, unmet) for every pair read; no reasons means review."""
    sums = judged.groupBy("alias", "entry_id").agg(
        F.count(F.lit(1)).alias("reasons"),
        F.count_if(F.col("result") == UNMET).alias("unmet"),
        F.bool_and(F.col("result") == MET).alias("all_met"),
    )
    rows = pairs.select("alias", "entry_id").distinct().join(sums, ["entry_id", "alias"], "left")
    v = F.when(F.col("unmet") > 0, UNFIT).when(F.col("all_met"), FIT).otherwise(REVIEW)
    return rows.select("alias", "entry_id", v.alias("verdict"), F.coalesce("reasons", F.lit(0)).alias("reasons"), F.coalesce("unmet", F.lit(0)).alias("unmet"))


def redecide(readings: DataFrame, requirements: DataFrame, companies: DataFrame) -> DataFrame:
    """All cards anew from stored verified requirements."""
    judged = evaluate_requirements(requirements.where("rejected is null"), companies)
    return verdict(readings, judged).withColumn("rules", F.lit(VERSION))


def turnover_from_profile(text: Column) -> Column:
    """The lowest amount of the profile's turnover row; null if none is published."""
    row = F.regexp_extract(text, UNICODE + r"\|\s*Cifra anual de negocio\s*\|([^|\n]*)\|", 1)
    amounts = F.transform(F.regexp_extract_all(row, F.lit(r"(\d[\d.,]*\d|\d)\s*€?"), 1), spanish_number)
    return F.when(~F.lower(row).contains("no publicada"), F.array_min(amounts))


# Form fields that make up a profile, in order.
SECTIONS = (
    ("que_hace", "1. Qué hace"),
    ("que_busca", "2. Qué busca"),
    ("certificaciones", "3. Certificaciones"),
    ("zona", "4. Zona"),
    ("cifra_negocio", "5. Cifra anual de negocio"),
)


def profile_text(clients: DataFrame) -> DataFrame:
    """clients with `text` (titled sections, empty ones left out) and its sha256."""
    value = lambda f: F.nullif(collapse(F.coalesce(F.col(f), F.lit(""))), F.lit(""))
    shown = {f: value(f) for f, _ in SECTIONS} | {"cifra_negocio": euros(spanish_number(value("cifra_negocio")))}
    parts = F.filter(F.array(*(F.concat(F.lit(f"## {title}\n\n"), shown[f]) for f, title in SECTIONS)), lambda x: x.isNotNull())
    return clients.withColumn("text", F.array_join(parts, "\n\n")).withColumn("sha256", F.sha2("text", 256))


MAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ALIAS = UNICODE + r"^[\w ]{2,40}$"
HIGHEST_CAP = 20


def validate_clients(clients: DataFrame, required: tuple[str, ...] = ("alias", "correo", "que_hace")) -> DataFrame:
    """clients with `errors`: field to what is wrong with it, empty if nothing is."""
    fields = ("alias", "correo", "que_hace", "cifra_negocio", "tope_diario_eur")
    clean = {f: collapse(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields}
    cap, turnover = spanish_number(clean["tope_diario_eur"]), spanish_number(clean["cifra_negocio"])
    given = lambda f: clean[f] != ""
    problem = {
        "alias": F.when(given("alias") & ~clean["alias"].rlike(ALIAS), "not a name"),
        "correo": F.when(given("correo") & ~clean["correo"].rlike(MAIL), "not an address"),
        "que_hace": F.when(given("que_hace") & (F.length(clean["que_hace"]) < 30), "too short"),
        "cifra_negocio": F.when(given("cifra_negocio") & ~F.coalesce(turnover > 0, F.lit(False)), "not a positive number"),
        "tope_diario_eur": F.when(
            given("tope_diario_eur"),
            F.when(cap.isNull(), "not a number").when(cap < 0, "negative").when(cap > HIGHEST_CAP, "above the maximum"),
        ),
    }
    pairs = []
    for f in fields:
        missing = F.when(~given(f), "required") if f in required else F.lit(None)
        pairs += [F.lit(f), F.coalesce(missing, problem[f])]
    return clients.withColumn("errors", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))
