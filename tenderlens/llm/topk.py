"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt into blocks; in a block every dimension is a list sorted by
component.  A query reads each list from the end that suits the sign of its own
component, entry after entry, and the deeper the more that list can move a score
(`|component| * range of the list`).  A candidate's lower bound adds the worst
value its unread lists can hold to what was read of it, its upper bound the value
at each list's reading front.  After each stretch of reading, candidates whose
upper bound is below the k-th lower bound are out for good; reading ends when few
survivors are left, ties included, and those get their final scores.  Shares read
are 1/8, 3/8 and 1; after a stretch that puts out less than a tenth of the rows
the rest is read at once.  Where bounds do not close early, a query so ends with
the lists read in full.
Queries come in blocks too; each pair of blocks is one group of bounded size,
and the k best of every pair meet in one ranking per query.

Scores are integer inner products of floor(scale * x); ties go to the smaller id.
Vectors that are null, or hold a null or a non-finite component, and null ids
take no part.  Vectors of other lengths than a query's are no candidates for it.
Repeated rows take part row by row (an id's own rows never match it); fewer
candidates than k give shorter lists; an empty table gives an empty result.
Only the id and the vector are read, so further columns, whatever their names,
change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 512
FIRST_SHARE, DEEPER = 1 / 8, 3
RESOLVED = 4
LISTED = "query_id long, vec_id long, score long"


class SortedLists:
    """One block of candidates, and each row's place in every dimension's sorted list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids = ids
        self.vectors = vectors.astype(np.float64)  # sums of products stay below 2**53, so they are exact
        self.small = self.vectors.astype(np.float32)
        self.most = float(np.abs(vectors).max(initial=0))
        by = np.argsort(vectors, axis=0, kind="stable")
        self.place = np.empty(by.shape, np.int16 if len(by) < 1 << 15 else np.int32)
        np.put_along_axis(self.place, by, np.arange(len(by), dtype=self.place.dtype)[:, None], 0)
        self.values = np.take_along_axis(self.vectors, by, 0)
        self.entries = self.read_entries = self.queries = self.closed_early = 0  # what reading came to, over all queries

    def best(self, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of each query's k best rows other than its own."""
        for number, query in zip(own.tolist(), queries.astype(np.float64), strict=True):
            at = self.survivors(number, query, k)
            scores = (self.vectors @ query)[at] if len(at) > len(self.ids) // 2 else self.vectors[at] @ query
            if len(at) > k:
                some = scores >= np.partition(scores, len(at) - k)[len(at) - k]
                at, scores = at[some], scores[some]
            first = np.lexsort((self.ids[at], -scores))[:k]
            yield number, self.ids[at[first]], scores[first].astype(np.int64)

    def survivors(self, own: int, query: np.ndarray, k: int) -> np.ndarray:
        """Rows other than the query's own that can be among the k best, once few are left or all lists are read."""
        reading = Reading(self, query)
        share = FIRST_SHARE
        while len(reading.rows) > RESOLVED * k and share < 1:
            lower, upper = reading.advance(share)
            lower[self.ids[reading.rows] == own] = -np.inf
            least = np.partition(lower, len(lower) - k)[len(lower) - k]
            before = len(reading.rows)
            reading.keep(upper >= least)  # the k best lower bounds stay, so the bound holds from one stretch to the next
            share = share * DEEPER if len(reading.rows) < 0.9 * before else 1
        if len(reading.rows) > RESOLVED * k:
            reading.depth[:] = reading.n  # what is left of the lists is read, so bounds are scores
        self.queries += 1
        self.closed_early += not reading.ended
        self.entries += self.place.size
        self.read_entries += int(reading.depth.sum())
        return reading.rows[self.ids[reading.rows] != own]


class Reading:
    """How far one query has read a block's lists, and what it knows of the rows still in question."""

    def __init__(self, lists: SortedLists, query: np.ndarray) -> None:
        self.n = len(lists.ids)
        self.query, self.values, self.up = query, lists.values, query > 0
        self.rows = np.arange(self.n)
        # an entry's place in the order of reading, but for a constant: lists of positive components are read from their large end
        self.order = lists.place * np.where(self.up, -1, 1).astype(lists.place.dtype)
        exact = 2 * lists.most * np.abs(query).sum() < 1 << 24  # then sums are whole numbers in single precision, too
        self.gain = lists.small * query.astype(np.float32) if exact else lists.vectors * query
        self.worst = query * np.where(self.up, self.values[0], self.values[-1])
        reach = np.abs(query) * (self.values[-1] - self.values[0])
        self.weight = reach / reach.mean() if reach.any() else np.ones(len(query))
        self.depth = np.zeros(len(query), np.int64)

    @property
    def ended(self) -> bool:
        return bool((self.depth == self.n).all())

    def advance(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Reads on until that share of all entries is read, the weightier lists deeper; (lower, upper) bounds of the rows."""
        wanted = np.full(len(self.depth), self.n) if share >= 1 else np.ceil(self.n * share * self.weight).astype(np.int64)
        self.depth = np.clip(wanted, np.minimum(self.depth + 1, self.n), self.n)
        lists, kind = np.arange(len(self.depth)), self.gain.dtype
        front = self.query * np.where(self.up, self.values[self.n - self.depth, lists], self.values[self.depth - 1, lists])
        read = (self.order < np.where(self.up, self.depth - self.n + 1, self.depth).astype(self.order.dtype)).astype(kind)
        known = np.einsum("ij,ij->i", self.gain, read)
        bounds = np.stack([self.worst, front], 1).astype(kind)
        unread = bounds.sum(0) - read @ bounds
        return known + unread[:, 0], known + unread[:, 1]

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.rows, self.order, self.gain = self.rows[which], self.order[which], self.gain[which]


def matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = rows["v"].combine_chunks()
    n = rows.num_rows
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows["id"].to_numpy().astype(np.int64), values.reshape(n, len(values) // n if n else 0)


def join_blocks(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    out: list[list] = [[], [], []]
    if queries.num_rows and candidates.num_rows:
        for own, ids, scores in SortedLists(*matrix(candidates)).best(*matrix(queries), k):
            out[0] += [own] * len(ids)
            out[1] += ids.tolist()
            out[2] += scores.tolist()
    return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part, v as integers."""
    usable = F.col(id_col).isNotNull() & F.col(vector).isNotNull()
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cast = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(usable).where(finite).select(F.col(id_col).cast("long").alias("id"), cast.alias("v"))


def dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with a block number per vector length, and (length, blocks) for each length."""
    counts = rows.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"n_{name}"))
    return rows.withColumn("dims", F.size("v")), counts


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where is_query holds, the k best other rows."""
    rows = quantised(vectors, id_col, vector, scale)
    asked = quantised(vectors.where(is_query), id_col, vector, scale)
    candidates, n_c = dealt(rows, BLOCK_ROWS, "c")
    queries, n_q = dealt(asked, QUERY_ROWS, "q")
    grid = n_c.join(n_q, "dims")  # one row per vector length
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_c")).cast("int")
    candidates = candidates.join(grid, "dims").select("id", "v", "dims", block.alias("c"), F.explode(F.sequence(F.lit(0), F.col("n_q") - 1)).alias("q"))
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("n_q")).cast("int")
    queries = queries.join(grid, "dims").select("id", "v", "dims", block.alias("q"), F.explode(F.sequence(F.lit(0), F.col("n_c") - 1)).alias("c"))
    keys = ("dims", "q", "c")
    listed = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda a, b: join_blocks(a, b, k), LISTED)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
