"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items (A-Z lower-cased; runs of digits, a-z
and bytes above ASCII) build one automaton.  Training words stream through it;
at every word it knows the longest stretch that ends there and occurs in some
item.  A stretch of `window` words, or a whole item that has fewer, marks its
words as hit and its items as seen.

Only stretches whose every word pair occurs in some item can match, so pairs
are looked up in bulk first and the automaton walks just those stretches; this
drops no match.  One automaton holds at most `max_words` item words and is
broadcast; longer benchmarks are dealt into groups of items, one pass over the
documents each, and hits are united per document.

Defined results: null or empty texts have no words, no hits and are clean;
an item without words matches nothing; repeated items count under each id;
items without an id mark words like others, count as one item together, and are
missing from item_ids and the hash of the ids;
repeated documents are judged row by row; empty tables give empty results; very
long texts are walked whole.  Docs' further columns are kept; working columns are
named __before, __doc and __found and may not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import column, map_texts
from .cluster import written
from .tokens import ALPHANUMERIC, Words, words_of

REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"
CLEAN = "clean_text string"
FOUND = "__found struct<at: array<int>, ids: array<string>>"
FOUND_TYPE = pa.struct([("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))])


class SuffixAutomaton:
    """All substrings of the items, as states; a state's strings end at the same places."""

    def __init__(self, items: list[list[int]], window: int) -> None:
        self.window = window
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in items:
            last = 0
            for w in words:
                last = self._append(last, w)
        self._mark(items)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the shorter strings of q, which from p on get a state of their own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.edges[q]))
        self.link[q] = clone
        while p >= 0 and self.edges[p].get(w) == q:
            self.edges[p][w] = clone
            p = self.link[p]
        return clone

    def _append(self, last: int, w: int) -> int:
        known = self.edges[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.edges[p]:
            self.edges[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.edges[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, items: list[list[int]]) -> None:
        """anchor[v]: v's suffix state that holds strings of `window` words; seen: its items; short: whole short items that end there."""
        n, k = len(self.length), self.window
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.anchor, self.short, self.seen = [-1] * n, [()] * n, {}
        for v in by_length:
            up = self.link[v]
            self.anchor[v] = v if self.length[up] < k <= self.length[v] else self.anchor[up]
        whole: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(items):
            v = 0
            for w in words:
                v = self.edges[v][w]
                if self.anchor[v] >= 0:
                    self.seen.setdefault(self.anchor[v], set()).add(number)
            if 0 < len(words) < k:
                whole.setdefault(v, []).append((len(words), number))
        for v in by_length:
            self.short[v] = (*self.short[self.link[v]], *whole.get(v, ()))

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, length, items) of every window and short item in words."""
        edges, link, length, k = self.edges, self.link, self.length, self.window
        v = long = 0
        for end, w in enumerate(words, 1):
            while v and w not in edges[v]:
                v = link[v]
                long = length[v]
            v = edges[v].get(w, 0)
            long = long + 1 if v else 0
            if long >= k:
                yield end, k, tuple(self.seen.get(self.anchor[v], ()))
            for size, number in self.short[v]:
                if size <= long:
                    yield end, size, (number,)


class Matcher:
    """The automaton with the tables that find the stretches worth walking."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.ids = [i for i, _ in items]
        words = words_of(pa.array([t for _, t in items], pa.string()), ALPHANUMERIC, fold=True)
        self.vocabulary = np.unique(words.hashes)
        numbers = np.searchsorted(self.vocabulary, words.hashes)
        sequences = [numbers[a:b].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.automaton = SuffixAutomaton(sequences, window)
        sizes = [min(window, len(s)) for s in sequences if s]
        self.least = min(sizes, default=window)
        within = np.ones(max(len(numbers) - 1, 0), bool)
        cuts = words.bounds[1:-1] - 1
        within[cuts[(cuts >= 0) & (cuts < len(within))]] = False
        self.pairs = np.unique((numbers[:-1] * len(self.vocabulary) + numbers[1:])[within])

    def stretches(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item word numbers (-1: none), and the ranges of words linked by known pairs within a row."""
        n = len(hashes)
        if not n or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == hashes, at, -1)
        linked = np.zeros(n + 1, bool)  # linked[i]: words i - 1 and i
        near = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
        if len(self.pairs) and len(near):
            keys = numbers[near] * len(self.vocabulary) + numbers[near + 1]
            found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            linked[near[self.pairs[found] == keys] + 1] = True
        linked[bounds] = False
        known = numbers >= 0
        starts = np.flatnonzero(known & ~linked[:-1])
        ends = np.flatnonzero(known & ~linked[1:]) + 1
        keep = ends - starts >= self.least
        return numbers, starts[keep], ends[keep]

    def scan(self, words: Words, items: list[set[str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges (of the batch) that match; adds the items seen in each row to `items`."""
        numbers, starts, ends = self.stretches(words.hashes, words.bounds)
        first, last = [], []
        rows = np.searchsorted(words.bounds, starts, "right") - 1
        for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            for end, size, seen in self.automaton.matches(numbers[a:b].tolist()):
                first.append(a + end - size)
                last.append(a + end)
                items[row].update(self.ids[i] for i in seen)
        return np.array(first, np.int64), np.array(last, np.int64)


def hit_words(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last, minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def without(words: Words, row: int, hit: np.ndarray, longest: int, all_spans: bool) -> str:
    """The row's text without its hit spans: every one past the coverage limit, else those of `longest` words or more."""
    a, b = words.bounds[row], words.bounds[row + 1]
    out, at = [], words.offsets[row]
    for s, e in zip(*spans(hit[a:b]), strict=True):
        if all_spans or e - s >= longest:
            out.append(words.data[at : words.starts[a + s]].tobytes())
            at = words.ends[a + e - 1]
    return b"".join([*out, words.data[at : words.offsets[row + 1]].tobytes()]).decode()


def reported(words: Words, first: np.ndarray, last: np.ndarray, items: list[set[str | None]], texts: pa.Array, longest: int, share: int, clean: bool) -> list[pa.Array]:
    hit = hit_words(len(words.hashes), first, last)
    total = np.concatenate([[0], np.cumsum(hit)])
    n_words, n_hit = words.counts, total[words.bounds[1:]] - total[words.bounds[:-1]]
    bad = (n_hit > 0) & (share * n_hit >= n_words)
    ids = [sorted(x - {None}) for x in items]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
    out = [
        pa.array(n_words),
        pa.array(n_hit),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array(digest),
        pa.array(bad),
        pa.array(ids, pa.list_(pa.string())),
    ]
    if clean:
        changed = [without(words, r, hit, longest, bool(bad[r])) if n_hit[r] else None for r in range(len(ids))]
        out.append(pc.if_else(pa.array(n_hit > 0), pa.array(changed, pa.string()), texts))
    return out


def item_groups(benchmark: DataFrame, id_col: str, text: str, max_words: int) -> tuple[DataFrame, int]:
    """Items as (id, text, group) and the number of groups: 1 unless the benchmark has too many words for one automaton."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    groups = 1 + total // (2 * max_words)  # a word and its separator take two bytes at least
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return items.withColumn("group", F.pmod(F.xxhash64("id", "text"), F.lit(groups))), groups


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, longest: int = 50, share: int = 20, keep: list[str] | None = None, clean: bool = True, max_words: int = 200_000, prefix: str = "") -> DataFrame:
    """Columns `keep` of docs (default: all) with n_words, n_hit, n_items, items_sha256, contaminated, item_ids and, on demand, clean_text.

    contaminated: n_hit > 0 and share * n_hit >= n_words.  clean_text lacks all
    hit spans of a contaminated text, and from others those of `longest` words.
    The new columns' names begin with prefix and replace docs' columns of those names.
    """
    report, cleaned = (", ".join(prefix + c for c in ddl.split(", ")) for ddl in (REPORT, CLEAN))
    made = {f.name for f in StructType.fromDDL(f"{report}, {cleaned}").fields}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    items, groups = item_groups(benchmark, item_id, item_text, max_words)
    ddl = f"{report}, {cleaned}" if clean else report
    found, carried = docs, []
    for g in range(groups):
        held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.col("group") == g).select("id", "text").orderBy("id", "text").collect()])
        final = g == groups - 1

        def prepare(held=held, final=final, carried=bool(carried)):
            matcher = Matcher(held.value, window)

            def make(texts: pa.Array, rows: pa.RecordBatch) -> list[pa.Array]:
                words = words_of(texts, ALPHANUMERIC, fold=True)
                before = column(rows, "__before").to_pylist() if carried else [{"at": [], "ids": []}] * len(texts)
                seen = [set(x["ids"]) for x in before]
                first, last = matcher.scan(words, seen)
                old = [(words.bounds[r] + a) for r, x in enumerate(before) for a in x["at"]]
                first, last = np.concatenate([first, np.array(old[::2], np.int64)]), np.concatenate([last, np.array(old[1::2], np.int64)])
                if final:
                    return reported(words, first, last, seen, texts, longest, share, clean)
                hit = hit_words(len(words.hashes), first, last)
                ranges = [[int(x) for pair in zip(*spans(hit[a:b]), strict=True) for x in pair] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                return [texts, pa.array([{"at": a, "ids": list(i)} for a, i in zip(ranges, seen, strict=True)], FOUND_TYPE)]

            return make

        if final:
            found = map_texts(found, "__doc" if carried else text, [*keep, *carried], ddl, prepare).drop(*carried)
        else:
            found = map_texts(found, "__doc" if carried else text, [*keep, *carried], f"__doc string, {FOUND}", prepare)
            found = written(found.drop(*carried).withColumnRenamed("__found", "__before"))
            carried = ["__before"]
    return found
