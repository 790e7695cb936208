"""Stand-in views of the procurement tables over the driver's tables, as DataFrames and as SQL.

Notices are order lines: the order is the dossier, its ship date the version.
Each view covers whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST, CUTOFF = "1996-01-01", "1997-01-01", "1999-01-01"
SEED = "20260927"
TODAY = "1998-06-01"
SALT = "sal"

# Stand-ins, matched to the invented prose, for the patterns that find evidence.
PATTERNS = {
    "requirements": {
        "volumen_negocios": r"tionthe|eauauxla",
        "trabajos_similares": r"anding|ungder",
        "certificaciones": r"Licensed under|ISO\s?\d{4,5}",
        "clasificacion": r"worthless|disgusting",
        "habilitacion": r"eaueau|keitung",
        "adscripcion": r"thesere|ciónla",
    },
    "section": r"onthe|dieach|eauxle",
    "figure": r"\d[\d.\s]{2,}",
    "defers": r"http|www|@",
    "boxes": r"[|#*]",
    "annexes": r"ingand|chung|reaux",
}


# Clauses in the words that such documents use.
CLAUSES = (
    " Solvencia económica: volumen anual de negocios de 250.000,00 euros.",
    " Clasificación empresarial: grupo V, subgrupo 2.",
    " Certificado ISO 9001 y Esquema Nacional de Seguridad; véase el anexo II.",
    " Cuadro resumen ......... 3 ......... 4 ......... 5",
    " Adscripción de medios y habilitación profesional.",
)


def prefix_a() -> tuple[str, ...]:
    return ("72", "48")


def _ts(c: str) -> Column:
    return F.col(c).cast("timestamp")


class Views:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def notices(self) -> DataFrame:
        code = F.concat(F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("0000"))
        rows = self.table("lineitem").join(
            self.table("orders"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        ).join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).join(
            self.table("customer"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        return rows.select(
            F.col("l_orderkey").alias("entry_id"),
            (_ts("l_shipdate") + F.make_dt_interval(mins=F.col("l_linenumber"))).alias("entry_updated"),
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("tie"),
            F.col("l_linestatus").alias("state"),
            F.array(code).alias("cpv"),
            F.col("p_name").alias("object"),
            F.col("c_nationkey").alias("organ"),
            F.col("o_totalprice").alias("amount"),
            F.to_date("o_orderdate").alias("deadline"),
            F.col("l_suppkey").alias("winner"),
            (F.col("l_returnflag") != "R").alias("sme"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        """Notice columns that only need the order line and its order."""
        rows = self.table("lineitem")
        return rows.select(
            F.col("l_orderkey").alias("entry_id"),
            (_ts("l_shipdate") + F.make_dt_interval(mins=F.col("l_linenumber"))).alias("entry_updated"),
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("tie"),
            F.col("l_linestatus").alias("state"),
            F.col("l_suppkey").alias("winner"),
            (F.col("l_returnflag") != "R").alias("sme"),
        )

    @cached_property
    def awards(self) -> DataFrame:
        names = self.table("supplier").select(F.col("s_suppkey").alias("winner"), F.col("s_name").alias("name"))
        return self.versions.select("entry_id", "entry_updated", "winner", "sme").join(names, "winner")

    @cached_property
    def companies(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_name").alias("alias"),
            F.col("s_suppkey").alias("winner"),
            F.col("s_acctbal").alias("turnover"),
            F.lit("registro").alias("turnover_source"),
            F.concat(F.lit("ISO "), (F.lit(9000) + F.col("s_suppkey") % 3).cast("string")).alias("profile"),
        )

    @cached_property
    def prefixes(self) -> DataFrame:
        two = lambda c: F.lpad((c % 100).cast("string"), 2, "0")
        key = F.col("winner")
        return self.companies.select(
            "alias",
            F.explode(F.array(two(key * 7), two(key * 13 + 5), F.concat(two(key * 3 + 1), F.lit("1")))).alias("prefix"),
        ).distinct()

    @cached_property
    def tombstones(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("entry_id"),
            _ts("o_orderdate").alias("deleted_at"),
            F.lit("ANULADA").alias("reason"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("call_id"),
            F.col("user_id").alias("company"),
            _ts("ts").alias("called_at"),
            F.col("value").alias("cost"),
        )

    @cached_property
    def triage(self) -> DataFrame:
        """One triage per company and dossier: each line's supplier, and the one after it."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("entry_id"),
            F.explode(F.array(F.col("l_suppkey"), F.col("l_suppkey") + 1)).alias("winner"),
        ).distinct()
        rows = lines.join(self.companies.select("alias", "winner"), "winner").select("entry_id", "alias")
        digit = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("entry_id").cast("string"), "alias", F.lit(SEED))), 1, 1), 16, 10).cast("int")
        decision = F.when(digit <= 5, "si").when(digit <= 7, "duda").when(digit <= 14, "no").otherwise("revisar")
        return rows.select(
            "entry_id",
            "alias",
            decision.alias("decision"),
            F.floor(F.col("entry_id") / 20).alias("call_id"),
            F.concat(F.lit("motivo "), digit.cast("string")).alias("reason"),
        )

    @cached_property
    def timed_triage(self) -> DataFrame:
        return self.triage.join(self.calls.select("call_id", F.col("called_at").alias("triaged_at")), "call_id")

    @cached_property
    def pages(self) -> DataFrame:
        """Lines of documents as pages, numbered from 1."""
        rows = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
        return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("page_no"), "text")

    @cached_property
    def clause_pages(self) -> DataFrame:
        """Pages, most of them with a clause as tender documents have them."""
        kind = (F.col("doc_id") + F.col("page_no")) % (len(CLAUSES) + 2)
        clause = F.coalesce(F.get(F.array(*map(F.lit, CLAUSES)), kind.cast("int")), F.lit(""))
        return self.pages.select("doc_id", "page_no", F.when(F.col("doc_id") % 5 > 0, F.concat("text", clause)).otherwise(F.col("text")).alias("text"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Every item's opening as a quote against each document page that its id points at, and the page's own opening; half of them spoilt."""
        pages = self.pages.select("doc_id", "page_no", "text")
        own = pages.select("doc_id", F.col("page_no").alias("page"), F.substring("text", 5, 60).alias("quote"))
        spoilt = own.withColumn("quote", F.when(F.col("page") % 2 == 0, F.col("quote")).otherwise(F.concat(F.lit("x"), F.col("quote"), F.lit("x"))))
        return spoilt.select(
            "doc_id",
            F.col("page").cast("string").alias("page"),
            "quote",
            F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int")).alias("kind"),
            F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 10.0).alias("amount"),
            F.concat(F.lit("ISO "), (9000 + F.col("page") % 3).cast("string")).alias("demand"),
        )

    @cached_property
    def docs(self) -> DataFrame:
        """A document per order: state by status, pages by amount."""
        state = F.when(F.col("o_orderstatus") == "O", "pendiente").when(F.col("o_orderstatus") == "P", "error").otherwise("descargado")
        return self.table("orders").select(
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_orderkey").alias("entry_id"),
            F.when(F.col("o_orderkey") % 3 == 0, "PPT").otherwise("PCAP").alias("kind"),
            state.alias("state"),
            (F.col("o_orderkey") % 4).cast("int").alias("attempts"),
            F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 97).cast("int")).alias("pages"),
            F.concat(F.lit("https://contrataciondelestado.es/d/"), F.col("o_custkey").cast("string")).alias("url"),
        )

    @cached_property
    def version_docs(self) -> DataFrame:
        """A document per version: its kind, state and attempts by its number."""
        rows = self.table("lineitem")
        number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        updated = _ts("l_shipdate") + F.make_dt_interval(mins=F.col("l_linenumber"))
        state = F.when(number % 7 <= 1, "pendiente").when(number % 7 == 2, "error").otherwise("descargado")
        kind = F.when(number % 3 == 0, "PPT").otherwise("PCAP")
        return rows.select(
            number.alias("doc_id"),
            F.col("l_orderkey").alias("entry_id"),
            updated.alias("entry_updated"),
            kind.alias("kind"),
            state.alias("state"),
            (number % 4).alias("attempts"),
        ).distinct()

    @cached_property
    def cards(self) -> DataFrame:
        """A decided card for every triage answered si."""
        verdict = F.when(F.col("entry_id") % 5 == 0, "apta").when(F.col("entry_id") % 5 == 1, "no_apta").otherwise("revisar")
        return self.timed_triage.where("decision = 'si'").select("alias", "entry_id", verdict.alias("verdict"), F.col("triaged_at").alias("decided_at"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        code = F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.when(F.col("p_size") % 2 == 0, F.lit("0000")).otherwise(F.lit("1000")))
        return self.table("part").select(code.alias("code"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("description"))


KINDS = ("volumen_negocios", "certificaciones", "no_se_exige", "remite", "otro")
_KINDS = "[" + ",".join(f"'{k}'" for k in KINDS) + "]"

# name: (views it builds on, SQL)
SQL_VIEWS: dict[str, tuple[str, str]] = {
    "notices": (
        "",
        "SELECT l_orderkey AS entry_id, l_shipdate + to_minutes(l_linenumber) AS entry_updated, l_partkey * 100000 + l_suppkey AS tie, l_linestatus AS state, "
        "lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0') || '0000' AS code, p_name AS object, c_nationkey AS organ, o_totalprice AS amount, "
        "CAST(o_orderdate AS DATE) AS deadline, l_suppkey AS winner, l_returnflag <> 'R' AS sme "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey",
    ),
    "versions": ("", (
        "SELECT l_orderkey AS entry_id, l_shipdate + to_minutes(l_linenumber) AS entry_updated, "
        "l_partkey * 100000 + l_suppkey AS tie, l_linestatus AS state, l_suppkey AS winner, l_returnflag <> 'R' AS sme "
        "FROM lineitem"
    )),
    "awards": ("versions", "SELECT v.entry_id, v.entry_updated, v.winner, v.sme, s_name AS name FROM versions v JOIN supplier ON s_suppkey = v.winner"),
    "companies": ("", (
        "SELECT s_name AS alias, s_suppkey AS winner, s_acctbal AS turnover, "
        "'ISO ' || CAST(9000 + s_suppkey % 3 AS VARCHAR) AS profile FROM supplier"
    )),
    "prefixes": (
        "companies",
        (
            "SELECT DISTINCT alias, unnest([lpad(CAST(winner * 7 % 100 AS VARCHAR), 2, '0'), "
            "lpad(CAST((winner * 13 + 5) % 100 AS VARCHAR), 2, '0'), lpad(CAST((winner * 3 + 1) % 100 AS VARCHAR), 2, "
            "'0') || '1']) AS prefix FROM companies"
        ),
    ),
    "tombstones": ("", "SELECT o_orderkey AS entry_id, o_orderdate AS deleted_at FROM orders WHERE o_orderstatus = 'F'"),
    "calls": ("", "SELECT event_id AS call_id, user_id AS company, ts AS called_at, value AS cost FROM events"),
    "triage": (
        "companies",
        "SELECT entry_id, alias, CASE WHEN d <= 5 THEN 'si' WHEN d <= 7 THEN 'duda' WHEN d <= 14 THEN 'no' ELSE 'revisar' END AS decision, entry_id // 20 AS call_id, 'motivo ' || CAST(d AS VARCHAR) AS reason FROM ("
        "SELECT entry_id, alias, CAST('0x' || substr(md5(CAST(entry_id AS VARCHAR) || '|' || alias || '|" + SEED + "'), 1, 1) AS INTEGER) AS d FROM ("
        "SELECT DISTINCT l_orderkey AS entry_id, unnest([l_suppkey, l_suppkey + 1]) AS winner FROM lineitem) x JOIN companies USING (winner)) y",
    ),
    "timed_triage": ("triage calls", "SELECT t.*, c.called_at AS triaged_at FROM triage t JOIN calls c USING (call_id)"),
    "pages_": ("", (
        "SELECT doc_id, unnest(range(1, len(l) + 1)) AS page_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, "
        "chr(10)) AS l FROM documents) d"
    )),
    "clause_pages": (
        "pages_",
        "SELECT doc_id, page_no, CASE WHEN doc_id % 5 > 0 THEN text || coalesce(["
        + ", ".join(f"'{c}'" for c in CLAUSES)
        + f"][(doc_id + page_no) % {len(CLAUSES) + 2} + 1], '') ELSE text END AS text FROM pages_",
    ),
    "quotes": (
        "pages_",
        "SELECT doc_id, page_no AS page, CASE WHEN page_no % 2 = 0 THEN q ELSE 'x' || q || 'x' END AS quote, " + _KINDS + (
            "[doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 3 > 0 THEN doc_id * 10.0 END AS amount, "
            "'ISO ' || CAST(9000 + page_no % 3 AS VARCHAR) AS demand FROM (SELECT doc_id, page_no, substr(text, 5, 60) AS q "
            "FROM pages_) p"
        ),
    ),
    "docs": (
        "",
        "SELECT o_orderkey AS doc_id, o_orderkey AS entry_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PPT' ELSE 'PCAP' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'pendiente' WHEN 'P' THEN 'error' ELSE 'descargado' END AS state, "
        "o_orderkey % 4 AS attempts, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 97 END AS pages, 'https://contrataciondelestado.es/d/' || CAST(o_custkey AS VARCHAR) AS url FROM orders",
    ),
    "version_docs": (
        "",
        "SELECT DISTINCT k AS doc_id, entry_id, entry_updated, CASE WHEN k % 3 = 0 THEN 'PPT' ELSE 'PCAP' END AS kind, CASE WHEN k % 7 <= 1 THEN 'pendiente' WHEN k % 7 = 2 THEN 'error' ELSE 'descargado' END AS state, k % 4 AS attempts "
        "FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS entry_id, l_shipdate + to_minutes(l_linenumber) AS entry_updated FROM lineitem) x",
    ),
    "cards": ("timed_triage", (
        "SELECT alias, entry_id, CASE entry_id % 5 WHEN 0 THEN 'apta' WHEN 1 THEN 'no_apta' ELSE 'revisar' END AS verdict, "
        "triaged_at AS decided_at FROM timed_triage WHERE decision = 'si'"
    )),
    "vocabulary": ("", (
        "SELECT lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN p_size % 2 = 0 THEN '0000' "
        "ELSE '1000' END AS code, p_name || ' ' || lower(p_type) AS description FROM part"
    )),
    # what most queries build on
    "first_versions": ("notices", (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_updated, tie) AS rn FROM notices) x "
        "WHERE rn = 1"
    )),
    "last_versions": ("notices", (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY entry_updated DESC, tie DESC) AS rn "
        "FROM notices) x WHERE rn = 1"
    )),
    "current": ("last_versions tombstones", (
        "SELECT l.*, t.entry_id IS NOT NULL AS withdrawn FROM last_versions l LEFT JOIN (SELECT DISTINCT entry_id "
        "FROM tombstones) t USING (entry_id)"
    )),
    "published": ("first_versions", f"SELECT * FROM first_versions WHERE entry_updated >= TIMESTAMP '{FIRST}' AND entry_updated < TIMESTAMP '{LAST}'"),
    "won": ("awards companies published", (
        f"SELECT DISTINCT c.alias, a.entry_id FROM awards a JOIN companies c ON a.winner = c.winner "
        f"WHERE a.entry_updated < TIMESTAMP '{CUTOFF}' AND a.entry_id IN (SELECT entry_id FROM published)"
    )),
    "universe": ("published", "SELECT count(*) AS dossiers, greatest(1, count(DISTINCT CAST(entry_updated AS DATE))) AS days FROM published"),
    "passing": (
        "published prefixes",
        "SELECT 'A' AS variant, CAST(NULL AS VARCHAR) AS alias, entry_id FROM published WHERE starts_with(code, '72') OR starts_with(code, '48') "
        "UNION ALL SELECT DISTINCT 'B', p.alias, n.entry_id FROM published n JOIN prefixes p ON p.prefix = substr(n.code, 1, length(p.prefix))",
    ),
}
