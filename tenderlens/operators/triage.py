"""Prompts out, answers in: every notice sent gets exactly one triage row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import json_object

DECISIONS = ("si", "no", "duda")


def build_prompts(batched: DataFrame, profiles: DataFrame, template: str, version: str) -> DataFrame:
    """(alias, batch, system, message, n, version, profile_sha): one row per batch of (alias, batch, ref, shown)."""
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("]\n"), F.col("shown"))
    batches = batched.groupBy("alias", "batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"),
    )
    head = F.when(F.col("n") == 1, F.lit("Esta es la licitación:")).otherwise(F.concat(
        F.lit("Estas son las "),
        F.col("n").cast("string"),
        F.lit(" licitaciones:"),
    ))
    rows = batches.join(profiles.select("alias", "text"), "alias")
    return rows.select(
        "alias",
        "batch",
        F.concat(F.lit(template + "\n\n"), F.col("text")).alias("system"),
        F.concat(head, F.lit("\n\n"), F.col("body")).alias("message"),
        "n",
        F.lit(version).alias("version"),
        F.sha2("text", 256).alias("profile_sha"),
    )


ANSWER = "decisiones array<struct<ref: string, decision: string, motivo: string>>"


def parse_decisions(responses: DataFrame) -> DataFrame:
    """(call_id, ref, decision, reason): of each reference the first valid decision; sí counts as si."""
    parsed = responses.select("call_id", F.from_json(json_object(F.col("body")), ANSWER)["decisiones"].alias("d"))
    rows = parsed.select("call_id", F.posexplode("d").alias("position", "x"))
    decision = F.translate(F.lower(F.trim("x.decision")), "í", "i")
    rows = rows.select(
        "call_id",
        "position",
        F.col("x.ref").try_cast("long").alias("ref"),
        decision.alias("decision"),
        F.col("x.motivo").alias("reason"),
    ).where(F.col("decision").isin(*DECISIONS) & F.col("ref").isNotNull())
    first = F.min_by(F.struct("decision", "reason"), "position").alias("f")
    return rows.groupBy("call_id", "ref").agg(first).select("call_id", "ref", "f.*")


def triage_rows(expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """expected (alias, entry_id, call_id, ref) with decision and reason; unanswered ones go to `revisar`."""
    rows = expected.join(decisions, ["call_id", "ref"], "left")
    return rows.withColumns({
        "decision": F.coalesce("decision", F.lit("revisar")),
        "reason": F.substring(F.coalesce("reason", F.lit("sin respuesta")), 1, 1000),
    })


def triage_health(expected: DataFrame, responses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per call: whether the answer was unreadable, how many references are missing, and how many were invented."""
    asked = expected.select("call_id", "ref", F.lit(1).alias("asked"))
    given = decisions.select("call_id", "ref", F.lit(1).alias("given"))
    both = asked.join(given, ["call_id", "ref"], "full").groupBy("call_id").agg(
        F.count_if(F.col("given").isNull()).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("invented"),
    )
    bad = responses.select("call_id", F.from_json(json_object(F.col("body")), ANSWER)["decisiones"].isNull().alias("unreadable"))
    return both.join(bad, "call_id", "left")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(alias, same, border, flip) of two variants' decisions on the same notices; si against no is a flip."""
    both = a.select("alias", "entry_id", F.col("decision").alias("x")).join(b.select("alias", "entry_id", F.col("decision").alias("y")), ["entry_id", "alias"])
    flip = F.array_sort(F.array("x", "y")) == F.array(F.lit("no"), F.lit("si"))
    return both.groupBy("alias").agg(
        F.count_if(F.col("x") == F.col("y")).alias("same"),
        F.count_if((F.col("x") != F.col("y")) & ~flip).alias("border"),
        F.count_if(flip).alias("flip"),
    )


def first_answer(triage: DataFrame) -> DataFrame:
    w = Window.partitionBy("alias", "entry_id").orderBy("call_id")
    return triage.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
