"""Line deduplication by pairwise patience alignment.

Lines are compared stripped of surrounding white space; empty lines never link
documents.  Equal line sequences are one text; its first document stands for it
and the others are deletions as a whole.  Rare lines, which RARE texts hold at
most, find the overlapping documents: every holder is paired with every earlier
one.  A line that more texts hold pairs each later holder with its first one only,
so n holders make n - 1 pairs and no line is too frequent to count; pairs that
several lines make are one.

Lines that all these pairs leave unaligned are paired on with their next earlier
holders, first 1, then 2, 4, ... of them, until they are aligned or no earlier
holder is left.  A holder can be passed over only where it cannot align the
line: patience aligns a line that is unique in both texts, or one that has the
same neighbour (past empty lines), above or below, in both.

Each pair is aligned by patience diff: lines unique in both texts, in the
longest common order, are fixed points, and blocks of equal lines grow from
them in both directions; texts without such lines align between their equal
ends.  Aligned blocks of `least_lines` lines or more go from the later document.
Deletions are judged on the input, never on what is left.

Defined results: null and empty texts have no lines; a null id is later than
every id and no partner; rows that repeat an id are no partners of one another;
an empty table gives an empty result; very long texts are aligned whole, by line.
Only the id and the text are read, so docs' further columns, whatever their
names, change nothing.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import column, map_texts
from .cluster import broadcast_within, written

WANTED_KEYS = 1_000_000
RARE = 8


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def line_hash(line: str) -> int:
    """64 bits of the stripped line; 0 for an empty one."""
    line = line.strip()
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True) if line else 0


def longest_rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(early: list[int], late: list[int]) -> list[tuple[int, int]]:
    """Aligned (early, late) positions of equal lines, rising in both."""
    once_early = {h: i for i, h in enumerate(early)}
    count_early, count_late = Counter(early), Counter(late)
    fixed = [(once_early[h], j) for j, h in enumerate(late) if h and count_late[h] == 1 and count_early[h] == 1]
    fixed = [fixed[i] for i in longest_rising([a for a, _ in fixed])]
    out: dict[int, int] = {}
    limits = [(-1, -1), *fixed, (len(early), len(late))]
    for (a, b), (c, d) in zip(limits, limits[1:], strict=False):
        i, j = a + 1, b + 1
        while i < c and j < d and early[i] == late[j]:  # grows down from the fixed point above
            out[j] = i
            i, j = i + 1, j + 1
        x, y = c - 1, d - 1
        while x >= i and y >= j and early[x] == late[y]:  # and up from the one below
            out[y] = x
            x, y = x - 1, y - 1
        if d < len(late):
            out[d] = c
    return sorted((i, j) for j, i in out.items())


def aligned_blocks(early: list[int], late: list[int], least_lines: int) -> list[int]:
    """Late positions in aligned blocks with at least that many lines that are not empty."""
    pairs = patience(early, late)
    out: list[int] = []
    run: list[int] = []
    for k, (i, j) in enumerate(pairs):
        if k and (i, j) != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            out += run if sum(late[x] != 0 for x in run) >= least_lines else []
            run = []
        run.append(j)
    return out + (run if sum(late[x] != 0 for x in run) >= least_lines else [])


def signature(hashes: list[int]) -> bytes:
    return hashlib.blake2b(np.array(hashes, np.int64).tobytes(), digest_size=16).digest()


def sign(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    def prepare():
        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            lines = [[line_hash(x) for x in lines_of(t)] for t in texts.to_pylist()]
            whole = [hashlib.sha256((t or "").encode()).digest() for t in texts.to_pylist()]
            return [pa.array(lines, pa.list_(pa.int64())), pa.array([signature(x) for x in lines], pa.binary()), pa.array(whole, pa.binary())]

        return make

    return map_texts(docs, text, [id_col], "lines array<long>, digest binary, whole binary", prepare)


def link_keys(lines: list[int]) -> dict[int, tuple[int, ...]]:
    """Per position of a line that is not empty: hashes of which an earlier text must share one to align it there."""
    counts = Counter(lines)
    at = [i for i, h in enumerate(lines) if h]
    ends = [-1, *at, len(lines)]
    joints = []  # two neighbours (0: the text's end) and the empty lines between them
    for a, b in zip(ends, ends[1:], strict=False):
        joints.append(hash((lines[a] if a >= 0 else 0, b - a, lines[b] if b < len(lines) else 0)))
    return {i: (joints[k], joints[k + 1], *((hash((lines[i],)),) if counts[lines[i]] == 1 else ())) for k, i in enumerate(at)}


def align(pairs: DataFrame, least_lines: int) -> DataFrame:
    """Of (doc, early, late): (doc, gone, at, keys), late positions that align with the earlier text, and link keys of shared ones that do not."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            gone, at, keys = [], [], []
            for early, late in zip(rows["early"], rows["late"], strict=True):
                aligned = aligned_blocks(early, late, least_lines)
                shared, done = set(early), set(aligned)
                rest = [j for j, h in enumerate(late) if h in shared and h and j not in done]
                known = link_keys(late) if rest else {}
                gone.append(aligned)
                at.append([j for j in rest for _ in known[j]])
                keys.append([k for j in rest for k in known[j]])
            arrays = [pa.array(gone, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), column(batch, "digest"), *arrays], ["doc", "digest", "gone", "at", "keys"])

    return pairs.select("doc", "digest", "early", "late").mapInArrow(run, "doc long, digest binary, gone array<int>, at array<int>, keys array<long>")


def key_holders(firsts: DataFrame) -> DataFrame:
    """(doc, key) of every text's link keys."""

    def run(batches):
        for batch in batches:
            keys = [sorted({k for own in link_keys(x).values() for k in own}) for x in column(batch, "lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(keys, pa.list_(pa.int64()))], ["doc", "keys"])

    return firsts.select("doc", "lines").mapInArrow(run, "doc long, keys array<long>").select("doc", F.explode("keys").alias("key"))


def align_rest(firsts: DataFrame, pairs: DataFrame, found: DataFrame, with_lines: Callable[[DataFrame], DataFrame], least_lines: int) -> DataFrame:
    """found, and what further pairs of its unaligned lines with their earlier holders align."""

    def without_gone(left: DataFrame, of: DataFrame) -> DataFrame:
        gone = of.select("doc", "digest", F.explode("gone").alias("at")).distinct()
        return left.join(gone, ["doc", "digest", "at"], "left_anti")

    zipped = found.where("size(at) > 0").select("doc", "digest", F.explode(F.arrays_zip("at", "keys")).alias("x"))
    left = written(without_gone(zipped.select("doc", "digest", "x.at", F.col("x.keys").alias("key")).distinct(), found))
    if left.isEmpty():
        return found
    wanted = broadcast_within(left.select("key").distinct(), WANTED_KEYS)
    holders = key_holders(firsts).join(wanted, "key", "left_semi").distinct()
    ranked = written(holders.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("doc")) - 1))
    left = left.join(ranked.withColumnRenamed("rank", "before"), ["key", "doc"]).where("before > 0")
    start, step = 0, 1
    while not (left := written(left)).isEmpty():
        ranks = F.explode(F.sequence(F.lit(start), F.least(F.lit(start + step), F.col("before")) - 1))
        tried = left.select("doc", "digest", "key", ranks.alias("rank")).join(ranked.withColumnRenamed("doc", "owner"), ["key", "rank"])
        fresh = written(tried.select("doc", "digest", "owner").distinct().join(pairs, ["doc", "digest", "owner"], "left_anti"))
        new = written(align(with_lines(fresh), least_lines))
        pairs, found = pairs.union(fresh), found.union(new)
        start, step = start + step, 2 * step
        left = without_gone(left.where(F.col("before") > start), new)
    return found


def line_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least_lines: int = 1, with_text: bool = True) -> DataFrame:
    """Per row: id, n_lines, n_removed, n_partners, kept_sha256 (kept lines joined by line ends), and kept_text."""
    signed = written(sign(docs, text, id_col).withColumn(id_col, F.col(id_col).cast("long")))
    firsts = signed.groupBy("digest").agg(F.min(id_col).alias("doc"), F.first("lines").alias("lines")).where("doc is not null")
    firsts = written(firsts)
    held = firsts.select("doc", "digest", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    owners = held.groupBy("line").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("holders")).where("owner <> last")
    owners = written(owners.drop("last"))  # a frequent line's rows can be split in a join of two plain tables
    linked = written(held.join(owners, "line").select("line", "holders", "owner", "doc", "digest"))
    rare = linked.where(F.col("holders") <= RARE).groupBy("line").agg(F.collect_list(F.struct("doc", "digest")).alias("late"))  # RARE rows at most
    rare = rare.select("late", F.explode("late.doc").alias("owner")).select(F.explode("late").alias("x"), "owner").select("x.doc", "x.digest", "owner")
    frequent = linked.where(F.col("holders") > RARE).select("doc", "digest", "owner")
    pairs = written(rare.union(frequent).where("owner < doc").distinct())
    late = firsts.select("doc", "digest", F.col("lines").alias("late"))
    early = firsts.select(F.col("doc").alias("owner"), F.col("lines").alias("early"))

    def with_lines(chosen: DataFrame) -> DataFrame:
        return chosen.join(late, ["doc", "digest"]).join(early, "owner")

    found = align_rest(firsts, pairs, written(align(with_lines(pairs), least_lines)), with_lines, least_lines)
    gone = found.groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n_partners"), F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    left = cut(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("body")).join(gone, "doc"))
    left = (left if with_text else left.drop("kept_text")).dropDuplicates(["doc", "whole"])
    rows = signed.select(F.col(id_col), "digest", "whole", F.size("lines").alias("n_lines")).join(
        firsts.select("digest", F.col("doc").alias("first")),
        "digest",
        "left",
    )
    rows = rows.join(left, (F.col(id_col) == F.col("doc")) & (rows["whole"] == left["whole"]), "left").drop(left["whole"])
    copy = F.coalesce(F.col(id_col) > F.col("first"), F.col(id_col).isNull() & F.col("first").isNotNull()) & (F.col("n_lines") > 0)
    return rows.select(
        id_col,
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(copy, F.col("n_lines")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("n_partners", F.when(copy, F.lit(1)).otherwise(0)).cast("long").alias("n_partners"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )


def cut(texts: DataFrame) -> DataFrame:
    """Of (doc, body, digest, n_partners, gone): each text with that digest without those lines."""

    def prepare():
        def make(bodies: pa.Array, batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for body, digest, gone in zip(bodies.to_pylist(), column(batch, "digest").to_pylist(), column(batch, "gone").to_pylist(), strict=True):
                lines, lost = lines_of(body), set(gone)
                kept = "\n".join(x for i, x in enumerate(lines) if i not in lost)
                out.append((
                    signature([line_hash(x) for x in lines]) == digest,
                    hashlib.sha256((body or "").encode()).digest(),
                    len(lost),
                    hashlib.sha256(kept.encode()).hexdigest(),
                    kept,
                ))
            kinds = (pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.string())
            return [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]

        return make

    made = map_texts(
        texts,
        "body",
        ["doc", "digest", "gone", "n_partners"],
        "same boolean, whole binary, cut long, cut_sha256 string, kept_text string",
        prepare,
    )
    return made.where("same").drop("same", "digest", "gone")
