"""Substring deduplication by De Bruijn compaction over word k-mers.

A window of k words is an edge between its first and last k - 1 words.  Windows
are taken in paths: maximal runs of consecutive windows of one text that share
their least m-gram, which depends on a window's content only, so equal windows
of different texts fall to the same m-gram.

1. Texts with equal words are one; of the others, m-grams that occur in two
   documents mark the paths that can hold a repeated edge at all.
2. Only those paths are kept.  Equal paths collapse into one, with its first
   source coordinate (document, word); the distinct ones give their edges, and a
   grouping finds the smallest document of each edge.
3. Repeated paths are compacted: where every occurrence of one is followed by the
   same other path, and every occurrence of that one preceded by the first, both
   are one chain.  Joins link such neighbours, and joins that triple their
   reach lead each path to the first one of its chain.  All paths of a chain occur in the
   same places, so that from here on only its first path is looked up: the chain's
   first source coordinate and its length stand for all its windows.
4. Where a chain occurs in a later document, its whole span goes, and is listed
   with the source coordinate.  SHA-256 digests of the span's words, taken anew from
   both texts at both coordinates, have to agree; a span whose digest differs stays.
5. A path's first document may still hold single edges that another path has from
   an earlier document; these are found by the window's 64-bit hash alone (among
   10**9 different windows two agree with odds of about 0.03).

Removed: words covered by a window that also starts in a document of smaller id.

Defined results: null and empty texts have no words; fewer than k words are
never removed; rows that repeat an id are judged against smaller ids only; a
null id is neither smaller nor larger than others, so its row stays whole; an
empty table gives an empty result; very long texts are hashed in stretches and
cut whole.  Only the id and the text are read, so docs' further columns, whatever
their names, change nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, emit_rows, lists, map_texts
from .cluster import discard, written, written_at
from .tokens import SPACE_SEPARATED, Words, mix, range_hashes, row_hashes, whole_windows, window_hashes, words_of

SECOND = np.uint64(0xD6E8FEB86659FD93)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        reach += step
    return out


def paths_of(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, m-gram and row of every path."""
    at = whole_windows(words.bounds, k) if len(words.hashes) >= k else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), at
    least = sliding_min(mix(window_hashes(words.hashes, m)), k - m + 1)[at]
    row = np.searchsorted(words.bounds, at, "right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at))), least[first], row[first]


def text_keys(words: Words) -> np.ndarray:
    """One 64-bit number per row for its word sequence."""
    return row_hashes(words.hashes * SECOND, words.bounds)


def sign(docs: DataFrame, text: str, id_col: str, k: int, m: int) -> DataFrame:
    """Per row: number of words, digest of the words, key, and the distinct m-grams of its paths."""

    def prepare():
        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            words = words_of(texts, SPACE_SEPARATED)
            _, _, grams, row = paths_of(words, k, m)
            order = np.lexsort((grams, row))
            grams, row = grams[order], row[order]
            fresh = np.ones(len(grams), bool)
            fresh[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
            grams, row = grams[fresh], row[fresh]
            digest = [hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in texts.to_pylist()]
            return [
                pa.array(words.counts, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(text_keys(words).view(np.int64)),
                lists(grams.view(np.int64), np.searchsorted(row, np.arange(len(texts) + 1))),
            ]

        return make

    return map_texts(docs, text, [id_col], "n_words long, digest binary, text_key long, grams array<long>", prepare)


PATHS = "doc long, text_key long, at int, path long, check long, before long, after long, windows array<long>"


def repeated_paths(texts: DataFrame, k: int, m: int) -> DataFrame:
    """Of (doc, body, grams): the paths whose m-gram is in grams, with their edges and the paths right before and after (0: none of these)."""

    def prepare():
        def make(bodies: pa.Array, batch: pa.RecordBatch) -> list:
            words = words_of(bodies, SPACE_SEPARATED)
            at, n, grams, row = paths_of(words, k, m)
            wanted = column(batch, "grams")
            flat = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(bodies), dtype=np.uint64), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            salt = np.uint64(0x9E3779B97F4A7C15)
            keep = np.isin(mix(grams + row.astype(np.uint64) * salt), mix(flat + owner * salt))
            at, n, row = at[keep], n[keep], row[keep]
            if not len(at):
                return [np.zeros(0, np.int64)] * 8
            end = at + n + k - 1
            windows = window_hashes(words.hashes, k)
            bounds = np.concatenate([[0], np.cumsum(n)])
            places = np.repeat(at - bounds[:-1], n) + np.arange(bounds[-1])
            docs = column(batch, "doc").to_numpy(zero_copy_only=False)
            keys = text_keys(words).view(np.int64)
            whole = batched(words.hashes, at, end)
            second = batched(mix(words.hashes ^ SECOND), at, end)
            side_by_side = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + n[:-1])
            return [
                docs[row],
                keys[row],
                (at - words.bounds[row]).astype(np.int32),
                whole,
                second,
                np.append(0, np.where(side_by_side, whole[:-1], 0)),
                np.append(np.where(side_by_side, whole[1:], 0), 0),
                lists(windows[places].view(np.int64), bounds),
            ]

        return make

    return emit_rows(texts, "body", ["doc", "grams"], PATHS, prepare)


def batched(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """range_hashes over bounded stretches, as signed numbers."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), 1 << 15):
        s, e = starts[i : i + (1 << 15)], ends[i : i + (1 << 15)]
        out[i : i + (1 << 15)] = range_hashes(values[s[0] : e[-1]], s - s[0], e - s[0])
    return out.view(np.int64)


def compact(distinct: DataFrame) -> DataFrame:
    """(number, head, ahead) of the repeated paths: the path that its chain begins with, and the chain's windows before it.

    In each round a path's pointer goes on twice by the way of the path that it points
    at, so that a chain of 3**r paths takes r rounds.  A chain cannot be a cycle, as
    its last occurrence in a text has to end.
    """
    whole = distinct.where("low < high")  # others hold only single repeated edges
    goes_on = whole.where("after <> 0").select(F.col("path").alias("before"), F.col("after").alias("path"), F.col("number").alias("previous"), F.col("n").alias("by"))
    linked = whole.select("number", "path", "before").join(goes_on, ["path", "before"], "left")
    is_head = F.col("previous").isNull()
    way = linked.select("number", F.coalesce("previous", "number").alias("head"), F.coalesce("by", F.lit(0)).alias("ahead"), is_head.alias("settled"))
    way, way_at = written_at(way)
    while not way.where("not settled").isEmpty():
        on = way.select(F.col("number").alias("head"), F.col("head").alias("beyond"), F.col("ahead").alias("more"), F.col("settled").alias("ends"))
        further = way.where("not settled")
        for _ in range(2):
            further = further.join(on, "head").select("number", F.col("beyond").alias("head"), (F.col("ahead") + F.col("more")).alias("ahead"), F.col("ends").alias("settled"))
        (way, further_at), done_at = written_at(way.where("settled").unionByName(further)), way_at
        discard(distinct.sparkSession, done_at)
        way_at = further_at
    return way.drop("settled")


def chains_of(distinct: DataFrame, way: DataFrame, earlier: DataFrame) -> DataFrame:
    """Per chain: its first path, first source coordinate, last document, windows, and places of edges with an earlier document."""
    paths = distinct.join(earlier, "number", "left").where("low < high or inner is not null").join(way, "number", "left")
    head, ahead = F.coalesce("head", "number"), F.coalesce("ahead", F.lit(0))
    first = F.when(F.col("number") == head, F.struct("path", "check", "low", "low_key", "source_at", "high"))
    inner = F.transform("inner", lambda i: i + ahead)
    chains = paths.groupBy(head.alias("chain")).agg(F.max(first).alias("first"), F.max(ahead + F.col("n")).alias("n"), F.flatten(F.collect_list(inner)).alias("inner"))
    return chains.select("first.*", "n", "inner")


def marked_grams(signed: DataFrame, id_col: str) -> DataFrame:
    """(doc, grams): of the first document of each word sequence, the m-grams that another one holds too."""
    first = signed.groupBy("digest").agg(F.min(id_col).alias("doc"), F.first("grams").alias("grams")).where("doc is not null")
    grams = first.select("doc", F.explode("grams").alias("gram"))
    shared = grams.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("gram")
    return grams.join(shared, "gram").groupBy("doc").agg(F.collect_list("gram").alias("grams"))


FOLLOWED = "array<struct<source: long, source_key: long, source_at: int, at: int, n: int>>"
HELD = f"doc long, text_key long, followed {FOLLOWED}, windows array<int>, asked array<struct<at: int, n: int>>"


def removals(docs: DataFrame, marked: DataFrame, text: str, id_col: str, k: int, m: int) -> DataFrame:
    """HELD: of each text the chains that it shares with an earlier document, single windows to remove, and the chains it is the source of.

    Tables that only lead to the next one are deleted once that is written.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("body")).join(marked, "doc")
    paths, paths_at = written_at(repeated_paths(texts, k, m))
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    distinct = paths.groupBy("path", "check").agg(
        F.min(F.struct("doc", "text_key", "at")).alias("first"), F.max("doc").alias("high"), only("before"), only("after"), F.first("windows").alias("windows")
    )
    source = [F.col("first.doc").alias("low"), F.col("first.text_key").alias("low_key"), F.col("first.at").alias("source_at")]
    distinct = distinct.select(
        F.xxhash64("path", "check").alias("number"),
        "path",
        "check",
        *source,
        "high",
        "before",
        "after",
        F.size("windows").alias("n"),
        "windows",
    )
    distinct, distinct_at = written_at(distinct)
    places, places_at = written_at(paths.select("doc", "text_key", "at", "path", "check"))
    discard(spark, paths_at)
    earlier, earlier_at = written_at(earlier_edges(distinct))
    way = compact(distinct)
    chains, chains_at = written_at(chains_of(distinct.drop("windows", "before", "after"), way, earlier))
    for at in (distinct_at, earlier_at):
        discard(spark, at)
    hits = places.join(chains, ["path", "check"])
    # later documents lose what they share with the chain's first one; that one loses what starts in an earlier document by way of another path
    later = F.col("doc") > F.col("low")
    followed = F.when(later, F.struct(F.col("low").alias("source"), F.col("low_key").alias("source_key"), "source_at", "at", "n"))
    inside = F.when(~later, F.transform("inner", lambda i: F.col("at") + i))
    hits = hits.select("doc", "text_key", followed.alias("followed"), inside.alias("inside")).where("followed is not null or size(inside) > 0")
    asked = chains.where("low < high").select(F.col("low").alias("doc"), F.col("low_key").alias("text_key"), F.struct(F.col("source_at").alias("at"), "n").alias("asked"))
    grouped = hits.unionByName(asked, allowMissingColumns=True).groupBy("doc", "text_key").agg(
        F.collect_list("followed").alias("followed"), F.flatten(F.collect_list("inside")).alias("windows"), F.collect_list("asked").alias("asked")
    )
    out = written(grouped)
    for at in (places_at, chains_at):
        discard(spark, at)
    return out


def earlier_edges(distinct: DataFrame) -> DataFrame:
    """(number, inner): places of a path's edges that another path has from an earlier first document."""
    edges = distinct.select("number", "low", F.posexplode("windows").alias("i", "window"))
    firsts = edges.groupBy("window").agg(F.min("low").alias("source"), F.max("low").alias("latest")).where("source < latest").select("window", "source")
    firsts, firsts_at = written_at(firsts)  # a frequent edge's rows can be split in a join of two plain tables
    later = edges.join(firsts, "window").where("source < low").select("number", "i")
    later, later_at = written_at(later)
    discard(distinct.sparkSession, firsts_at)
    return later.groupBy("number").agg(F.collect_list("i").alias("inner"))


REPEATS = "array<struct<at: long, n_words: long, source: long, source_at: long>>"
SPANS = "array<struct<at: long, n_words: long, source: long, source_key: long, source_at: long, digest: binary>>"


def cut(texts: DataFrame, k: int) -> DataFrame:
    """Of (doc, body, HELD): what is left of each text whose words have that key, the spans that it repeats, and digests of what others repeat."""
    answers = "array<struct<at: long, n_words: long, digest: binary>>"
    ddl = f"same boolean, n_removed long, kept_sha256 string, n_spans int, longest_span int, spans {SPANS}, answers {answers}, kept_text string"
    told = pa.list_(pa.struct([("at", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary())]))
    kind = pa.list_(pa.struct([*((c, pa.int64()) for c in ("at", "n_words", "source", "source_key", "source_at")), ("digest", pa.binary())]))

    def prepare():
        def make(bodies: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
            words = words_of(bodies, SPACE_SEPARATED)
            same = text_keys(words).view(np.int64) == column(batch, "text_key").to_numpy(zero_copy_only=False)
            followed, windows, asked, out = *(column(batch, c).to_pylist() for c in ("followed", "windows", "asked")), []
            for i, body in enumerate(bodies.to_pylist()):
                n = int(words.counts[i])
                spans = sorted(followed[i], key=lambda x: x["at"]) if same[i] else []
                single = np.array(windows[i] if same[i] else [], np.int64)
                first = np.concatenate([np.array([x["at"] for x in spans], np.int64), single])
                end = np.concatenate([np.array([x["at"] + x["n"] - 1 + k for x in spans], np.int64), single + k])
                gone = np.cumsum(np.bincount(first, minlength=n + 1)[:n] - np.bincount(end, minlength=n + 1)[:n]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                stretches = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
                own = (body or "").encode().split()
                digest = lambda x: hashlib.sha256(b" ".join(own[x["at"] : x["at"] + x["n"] - 1 + k])).digest()  # noqa: E731, B023
                kept = b" ".join(own[j] for j in np.flatnonzero(~gone).tolist())
                repeats = [{**x, "n_words": x["n"] - 1 + k, "digest": digest(x)} for x in spans]
                answers = [{"at": x["at"], "n_words": x["n"] - 1 + k, "digest": digest(x)} for x in asked[i]] if same[i] else []
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), len(stretches), int(stretches.max(initial=0)), repeats, answers, kept.decode()))
            removed, sha, n_spans, longest, repeats, answers, kept = (list(x) for x in zip(*out, strict=True))
            return [
                pa.array(same),
                pa.array(removed, pa.int64()),
                pa.array(sha),
                pa.array(n_spans, pa.int32()),
                pa.array(longest, pa.int32()),
                pa.array(repeats, kind),
                pa.array(answers, told),
                pa.array(kept),
            ]

        return make

    held = ["doc", "text_key", "followed", "windows", "asked"]
    return map_texts(texts, "body", held, ddl, prepare).where("same").drop("windows", "followed", "asked", "same").dropDuplicates(["doc", "text_key"])


SOURCE = ["source", "source_key", "source_at", "n_words"]


def differing(left: DataFrame) -> DataFrame:
    """(doc, text_key, at) of the spans whose words are not those at their source coordinates; empty unless path hashes met by chance."""
    claims = left.select("doc", "text_key", F.inline("spans"))
    answers = left.select(F.col("doc").alias("source"), F.col("text_key").alias("source_key"), F.inline("answers")).withColumnRenamed("at", "source_at")
    both = claims.select(*SOURCE, "digest", F.lit(0).alias("told")).unionByName(answers.withColumn("told", F.lit(1)))
    bad = both.groupBy(*SOURCE).agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.max("told").alias("told")).where("least <> most or told = 0")
    bad = written(bad.select(*SOURCE))
    return claims.join(bad, SOURCE).join(answers, SOURCE, "left").where(~claims["digest"].eqNullSafe(answers["digest"])).select("doc", "text_key", "at")


def cut_verified(texts: DataFrame, gone: DataFrame, k: int, with_text: bool) -> DataFrame:
    """cut() of the texts, without the spans that differ from their source."""
    left = lambda held: cut(texts.join(held, "doc"), k).drop(*([] if with_text else ["kept_text"]))
    found = written(left(gone))
    wrong = written(differing(found).groupBy("doc", "text_key").agg(F.collect_set("at").alias("wrong")))
    if wrong.isEmpty():
        return found
    agreeing = F.filter("followed", lambda x: ~F.array_contains("wrong", x["at"].cast("long")))
    again = left(gone.join(wrong, ["doc", "text_key"]).withColumn("followed", agreeing).drop("wrong"))
    return found.join(wrong, ["doc", "text_key"], "left_anti").unionByName(again)


def substring_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 13, m: int = 4, with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of kept words joined by one space), the spans removed, and kept_text.

    n_spans and longest_span (words) count removed stretches; repeats lists the
    verified occurrences of chains: the same n_words stand at `at` here and at
    `source_at` in document `source`.  A row whose words are all those of an earlier
    document is one stretch and lists no repeats.
    """
    full, full_at = written_at(sign(docs, text, id_col, k, m))
    marked, marked_at = written_at(marked_grams(full, id_col))
    signed = written(full.drop("grams"))
    discard(docs.sparkSession, full_at)
    gone = removals(docs, marked, text, id_col, k, m)
    discard(docs.sparkSession, marked_at)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("body"))
    left = cut_verified(texts, gone, k, with_text).withColumnsRenamed({"n_removed": "cut"}).withColumnRenamed("kept_sha256", "cut_sha256")
    listed = F.transform("spans", lambda x: F.struct(*(x[c].alias(c) for c in ("at", "n_words", "source", "source_at"))))
    left = left.withColumn("repeats", listed).drop("spans", "answers")
    first = signed.groupBy("digest").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first)  # a text with many copies can be split in a join of two plain tables
    rows = signed.select(F.col(id_col), "n_words", "digest", "text_key").join(first, "digest", "left").join(
        left,
        (F.col(id_col) == F.col("doc")) & (signed["text_key"] == left["text_key"]),
        "left",
    ).drop(left["text_key"])
    whole = F.coalesce(F.col(id_col) > F.col("first"), F.lit(False)) & (F.col("n_words") >= k)  # an equal text has a smaller id
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = rows.select(
        id_col,
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, none).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("int").alias("n_spans"),
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("longest_span", F.lit(0))).cast("int").alias("longest_span"),
        F.coalesce(F.when(~whole, F.col("repeats")), F.array().cast(REPEATS)).alias("repeats"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
    return out
