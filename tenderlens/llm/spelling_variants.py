"""Spelling variants of words by range searches in k-d trees over letter counts.

Inserting, deleting or replacing one letter moves a word's vector of letter
counts by an L1 distance of at most two.  Near words are hence among the points
within 2 of a word in the tree of its own length, and within 1 in the tree of the
next length.

1. Words are counted where the texts are and summed by a shuffle.
2. Vectors are unary codes in 128 bits: 4 bits for each letter a to z and for each
   of 6 groups of the other letters.  The L1 distance of two vectors, counts above
   4 being cut, is the number of differing bits; a box is the bits that all its
   points have and the bits that any has.  Cutting and grouping only lower
   distances, so no near word is lost.
3. The top of every length's tree is grown on the driver from at most SAMPLE words
   (which sets how even its cells are, not what is found), into cells of near
   `cell_words`; a word is a point of one cell and a visitor of all cells whose box
   is within reach.  Cells are groups of a shuffle.
4. Each cell grows the rest of its tree, prunes boxes for all its visitors level by
   level, and verifies the order of letters of what the leaves hold.  It returns
   counts and the best near word, not pairs.
5. A word's form is the near word that occurs most often (of equal ones the first in
   code-point order) if it does so at least `ratio` times as often; its root is
   found by doubling the step along the forms.

Defined results: null texts have no words; a null id counts as an empty one in the
planted deletions of the query; equal rows count as often as they occur; texts
without letters and an empty table give no words; very long texts are read in one
piece, very long words are compared whole.  Only the text (and the id in the query)
is read, so further columns change nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column
from .cluster import checkpointed, discard, written, written_at

RUN = re.compile("[a-zÀ-ÿ]+")
FLUSH = 200_000
SAMPLE = 65_536
LEAF = 16
QUERIES = 2048
LONG = 64  # lengths from here on share one tree
MAX_DEPTH = 12


def runs_of(text: str) -> dict[str, int]:
    """Runs of letters with A-Z, and only those, lower-cased, and how often each occurs."""
    return Counter(RUN.findall(text.encode().lower().decode()))


def one_letter_less(doc_id: object, runs: dict[str, int], every: int = 199) -> dict[str, int]:
    """runs, of which those whose checksum with the id `every` divides lose one letter."""
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: dict[str, int] = {}
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), salt)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame, text: str = "text", id_col: str | None = None, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of all words of that length that occur that often; with id_col, after one_letter_less()."""
    columns = ([F.col(id_col).alias("__id")] if id_col else []) + [F.col(text).alias("__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: dict[str, int] = {}
        for batch in batches:
            ids = column(batch, "__id").to_pylist() if id_col else [None] * batch.num_rows
            for doc_id, body in zip(ids, column(batch, "__text").to_pylist(), strict=True):
                runs = runs_of(body or "")
                for word, n in (one_letter_less(doc_id, runs) if id_col else runs).items():
                    if len(word) >= min_length:
                        total[word] = total.get(word, 0) + n
                if len(total) > FLUSH:
                    yield out()
                    total = {}
        if total:
            yield out()

    return docs.select(*columns).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and where each begins and ends."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return flat, bounds


def vectors(words: list[str]) -> np.ndarray:
    """(words, 2): unary codes of the letter counts."""
    flat, bounds = letters_of(words)
    place = np.where((flat >= 97) & (flat <= 122), flat - 97, 26 + flat % 6).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(words)), np.diff(bounds)) * 32 + place, minlength=32 * len(words)).reshape(-1, 32)
    unary = ((1 << np.minimum(counts, 4)) - 1).astype(np.uint64)
    shifts = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return np.stack([np.bitwise_or.reduce(unary[:, :16] << shifts, axis=1), np.bitwise_or.reduce(unary[:, 16:] << shifts, axis=1)], axis=1)


def _bits(points: np.ndarray) -> np.ndarray:
    return np.unpackbits(points.view(np.uint8).reshape(len(points), 16), axis=1, bitorder="little")


def _halves(points: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The bit that cuts the points most evenly, and the points' bits; None if all points are equal."""
    bits = _bits(points)
    ones = bits.sum(axis=0, dtype=np.int64)
    even = np.abs(2 * ones - len(points))
    bit = int(even.argmin())
    return None if even[bit] == len(points) else (bit, bits[:, bit].astype(bool))


class Tree:
    """A k-d tree: nodes with boxes, leaves with a range of `order`."""

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.order = points, np.arange(len(points))
        nodes: list[tuple[int, int, int, int]] = []  # left, right, first, end
        low, high = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            own = points[self.order[first:end]]
            number = len(nodes)
            nodes.append((-1, -1, first, end))
            low.append(np.bitwise_and.reduce(own, axis=0))
            high.append(np.bitwise_or.reduce(own, axis=0))
            if parent >= 0:
                p = nodes[parent]
                nodes[parent] = (number, *p[1:]) if side == 0 else (p[0], number, *p[2:])
            cut = _halves(own) if end - first > LEAF else None
            if cut:
                part = self.order[first:end]
                middle = first + int((~cut[1]).sum())
                self.order[first:end] = np.concatenate([part[~cut[1]], part[cut[1]]])
                todo += [(first, middle, number, 0), (middle, end, number, 1)]
        self.nodes, self.low, self.high = np.array(nodes), np.array(low), np.array(high)

    def within(self, queries: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) numbers at a distance within each query's reach, in pieces."""
        for at in range(0, len(queries), QUERIES):
            query = np.arange(at, min(len(queries), at + QUERIES))
            node = np.zeros(len(query), np.int64)
            while len(query):
                off = np.bitwise_count((queries[query] & ~self.high[node]) | (self.low[node] & ~queries[query])).sum(axis=1)
                near = off <= reach[query]
                query, node = query[near], node[near]
                leaf = self.nodes[node, 0] < 0
                yield from self._held(queries, reach, query[leaf], node[leaf])
                query, node = np.repeat(query[~leaf], 2), self.nodes[node[~leaf], :2].ravel()

    def _held(self, queries: np.ndarray, reach: np.ndarray, query: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = self.nodes[node, 3] - self.nodes[node, 2]
        i = 0
        ends = np.cumsum(sizes)
        while i < len(query):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + (1 << 18), "right")))
            n = sizes[i:j]
            own = np.repeat(query[i:j], n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            point = self.order[np.repeat(self.nodes[node[i:j], 2], n) + inner]
            near = np.bitwise_count(queries[own] ^ self.points[point]).sum(axis=1) <= reach[own]
            yield own[near], point[near]
            i = j


def ends_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First and last 8 letters of each word, a byte each, the outermost letter in the lowest byte; shorter words end in zeros."""
    flat, bounds = letters_of(words)
    flat = np.concatenate([flat, [0]]).astype(np.uint64)
    first, last = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for i in range(8):
        held = np.diff(bounds) > i
        first[held] |= flat[bounds[:-1][held] + i] << np.uint64(8 * i)
        last[held] |= flat[bounds[1:][held] - 1 - i] << np.uint64(8 * i)
    return first, last


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of 8 bytes two numbers differ."""
    x = a ^ b
    for step in (4, 2, 1):
        x = x | (x >> np.uint64(step))
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the lowest bytes of two numbers agree before the first that does not."""
    x = a ^ b
    return np.bitwise_count(~x & (x - np.uint64(1))) >> 3


class Letters:
    """Words and the order of their letters."""

    def __init__(self, words: list[str]) -> None:
        self.flat, self.bounds = letters_of(words)
        self.length = np.diff(self.bounds)
        self.first, self.last = ends_of(words)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i], which is as long or one longer, differ by exactly one edit: their ends tell most apart, then all letters are read."""
        m = self.length[a]
        longer = self.length[b] > m
        start, stop = _agreeing(self.first[a], self.first[b]), _agreeing(self.last[a], self.last[b])
        changed = (_differing(self.first[a], self.first[b]) <= 1) & (_differing(self.last[a], self.last[b]) <= 1)
        added = (start == 8) | (stop >= np.minimum(8, m - np.minimum(m, start)))
        left = np.flatnonzero(np.where(longer, added, changed))
        out = np.zeros(len(a), bool)
        out[left] = self._read(a[left], b[left], longer[left])
        return out

    def _read(self, a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        size = self.length[a]
        for more in (0, 1):
            for m in np.unique(size[longer == more]).tolist():
                chosen, step = np.flatnonzero((longer == more) & (size == m)), max(1, (1 << 20) // m)
                for i in range(0, len(chosen), step):
                    c = chosen[i : i + step]
                    x, y = self.flat[self.bounds[a[c]][:, None] + np.arange(m)], self.flat[self.bounds[b[c]][:, None] + np.arange(m + more)]
                    if more:  # equal up to some place and, one letter on, equal from there
                        before = np.cumprod(x == y[:, :-1], axis=1).sum(axis=1)
                        after = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                        out[c] = before + after >= m
                    else:
                        out[c] = (x != y).sum(axis=1) == 1
        return out


NEAR = "word string, n_near long, near string, near_n long"


def near_in_cell(table: pa.Table) -> pa.Table:
    """Of a cell's points and visitors (word, n, point): per word, its near words' number and the best one."""
    words, n, is_point = table["word"].to_pylist(), table["n"].to_numpy(), table["point"].to_numpy(zero_copy_only=False)
    own, visitors = np.flatnonzero(is_point), np.flatnonzero(~is_point)
    letters, codes = Letters(words), vectors(words)
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, object), kind="stable")] = np.arange(len(words))
    count = np.zeros(len(words), np.int64)
    best_n, best = np.zeros(len(words), np.int64), np.full(len(words), -1)

    def take(word: np.ndarray, other: np.ndarray) -> None:
        """Counts other's words as near to word's and keeps the best: of most occurrences, then first in order."""
        count[:] += np.bincount(word, minlength=len(words))
        order = np.lexsort((place[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        word, other = word[first], other[first]
        better = (n[other] > best_n[word]) | ((n[other] == best_n[word]) & (place[other] < place[best[word]]))
        best_n[word[better]], best[word[better]] = n[other[better]], other[better]

    if len(own):
        size = letters.length[own].min()
        mixed = size >= LONG  # words of several lengths
        # a visitor of the points' own length is within 2, a shorter one within 1
        reach = np.where(mixed | (letters.length[visitors] == size), 2, 1)
        for query, point in Tree(codes[own]).within(codes[visitors], reach):
            a, b = visitors[query], own[point]
            more = letters.length[b] - letters.length[a]
            # of two words of one length, each visits the other: one meeting counts for both
            fits = (more == 1) | ((more == 0) & (place[a] < place[b]))
            a, b = a[fits], b[fits]
            near = letters.one_edit(a, b)
            take(np.concatenate([a[near], b[near]]), np.concatenate([b[near], a[near]]))
    noted = np.flatnonzero(count)
    return pa.table(
        {
            "word": pa.array([words[i] for i in noted], pa.string()),
            "n_near": pa.array(count[noted], pa.int64()),
            "near": pa.array([words[i] for i in best[noted]], pa.string()),
            "near_n": pa.array(best_n[noted], pa.int64()),
        }
    )


def top_cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and values of the cells that a tree of that depth over the points has; together they hold every vector once."""
    masks, values = [], []
    todo = [(points, np.zeros(2, np.uint64), np.zeros(2, np.uint64), depth)]
    while todo:
        own, mask, value, left = todo.pop()
        cut = _halves(own) if left and len(own) > 1 else None
        if not cut:
            masks.append(mask)
            values.append(value)
            continue
        bit = np.zeros(2, np.uint64)
        bit[cut[0] // 64] = np.uint64(1) << np.uint64(cut[0] % 64)
        todo += [(own[~cut[1]], mask | bit, value, left - 1), (own[cut[1]], mask | bit, value | bit, left - 1)]
    return np.array(masks), np.array(values)


def dealt(words: DataFrame, cell_words: int | None) -> DataFrame:
    """(cell, word, n, point): every word as a point of its cell and a visitor of the cells of its and the next length within reach."""
    length = F.least(F.char_length("word"), F.lit(LONG)).alias("length")
    counts = {r["length"]: r["n_words"] for r in words.groupBy(length).agg(F.count(F.lit(1)).alias("n_words")).collect()}  # LONG rows at most
    total = sum(counts.values())
    target = cell_words or min(1 << 16, max(1 << 12, total // 32))
    rate = min(1.0, SAMPLE / max(1, total))
    by_hash = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    sampled = [r["word"] for r in words.where(by_hash).select("word").limit(2 * SAMPLE).collect()]
    tops: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, n in counts.items():
        depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(n / target))))
        own = [w for w in sampled if min(len(w), LONG) == size]
        tops[size] = top_cells(vectors(own) if own else np.zeros((0, 2), np.uint64), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n = column(batch, "word").to_pylist(), column(batch, "n")
            codes = vectors(own)
            sizes = np.array([min(len(w), LONG) for w in own])
            rows, cells, points = [], [], []
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for step, reach in ((0, 2), (1, 1)):
                    if size + step not in tops or (size == LONG and step):
                        continue
                    masks, values = tops[size + step]
                    for cell, (mask, value) in enumerate(zip(masks, values, strict=True)):
                        off = np.bitwise_count((codes[at] ^ value) & mask).sum(axis=1)
                        name = f"{size + step}:{cell}"
                        for chosen, point in ((at[off <= reach], False), *([(at[off == 0], True)] if not step else [])):
                            rows.append(chosen)
                            cells += [name] * len(chosen)
                            points.append(np.full(len(chosen), point))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.string()), column(batch, "word").cast(pa.string()).take(at), n.take(at), pa.array(np.concatenate(points))], ["cell", "word", "n", "point"]
                )

    return words.select("word", "n").mapInArrow(run, "cell string, word string, n long, point boolean")


def with_roots(formed: DataFrame) -> DataFrame:
    """formed with root: the last of the forms from word on. Steps double, so chains of n forms take about log2(n) joins."""
    steps, at = written_at(formed.where("form is not null").select("word", F.col("form").alias("to")))
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        longer, fresh = written_at(steps.join(ahead, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        discard(formed.sparkSession, at)
        at = fresh
        if not longer.where("moved").limit(1).count():
            break
        steps = longer.drop("moved")
    return formed.join(longer.select("word", F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(words: DataFrame, ratio: int = 5, cell_words: int | None = None) -> DataFrame:
    """Of distinct (word, n): word, form, root, n, n_near, form_n."""
    words = written(words)
    found = dealt(words, cell_words).groupBy("cell").applyInArrow(near_in_cell, NEAR)
    # of one word's best near words in several cells the most frequent, then the first
    order = F.struct((-F.col("near_n")).alias("less"), "near")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    return with_roots(written(formed)).select("word", "form", "root", "n", "n_near", "form_n")
