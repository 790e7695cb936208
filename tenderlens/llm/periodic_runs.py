"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least four periods and six words long, that no neighbouring
word extends.  For every dyadic scale L, 1, 2, 4, ..., texts are cut into blocks
of L words at multiples of L.  A run of a period q with L <= q < 2 L holds at
least one such block together with the block's next occurrence, q words on.  So:

1. The squared differences between a block and its following window, summed for
   every distance from L to 2 L - 1, are computed at once: two sums of squares
   and one correlation, by a number-theoretic transform modulo a prime that the
   sums cannot reach, hence exactly.  Words stand as 8-bit codes of their hashes.
   Blocks of more than MAX_BLOCK words are represented by their first MAX_BLOCK.
2. Distances whose sum is zero are seeds: each is extended to both sides while
   words that distance apart have the same 64-bit hash.
3. Of stretches over one interval the smallest distance is the period; what is
   shorter than four periods or six words goes.  Every run is compared word by
   word at the end; a text whose hashes deceive is done again with exact numbers.

Two exact conditions keep blocks out of the transforms: a word of the block that
does not come again within 2 L words, and a block that lies with its whole window
in a run already found (its distances could only be multiples of that period).

A text is one task's work, whole; texts are never joined, so nothing is shuffled
and a lost task is run again alone.  A frequent text or word costs no more than others.

Defined results: null and empty texts have no words and no runs; equal rows give
equal results; an empty table stays empty; very long texts are done whole, in
memory proportional to their words.  Only the columns named in `keep` and the
text are read; keep must not hold `n_words`, `runs`, `best` or `collapsed`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_texts
from .tokens import SPACE_SEPARATED, Words, mix, words_of

PRIME, ROOT = 998_244_353, 3  # 2**23 divides PRIME - 1
MAX_BLOCK = 8192  # 255 ** 2 * MAX_BLOCK < PRIME
TABLE = 1 << 20
LEAST_WORDS, LEAST_EXPONENT = 6, 4
NEVER = np.int64(1 << 60)


@cache
def _twiddles(n: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the roots of unity for halves n / 2, n / 4, ..., 1."""
    out = []
    half = n // 2
    while half:
        w = pow(ROOT, (PRIME - 1) // (2 * half), PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        powers = np.ones(half, np.uint64)
        reach = 1
        while reach < half:
            powers[reach : 2 * reach] = powers[:reach] * np.uint64(pow(w, reach, PRIME)) % np.uint64(PRIME)
            reach *= 2
        out.append(powers[:, None])
        half //= 2
    return out


def _wrapped(x: np.ndarray) -> np.ndarray:
    """x or x - PRIME, whichever is a residue; x is below twice the prime."""
    return np.minimum(x, x - np.uint64(PRIME))


def ntt(a: np.ndarray) -> np.ndarray:
    """Transform of every column of a (n, columns); the frequencies come in bit-reversed order."""
    n, columns = a.shape
    p = np.uint64(PRIME)
    for w in _twiddles(n, False):
        half = len(w)
        x = a.reshape(-1, 2, half, columns)
        u, v = x[:, 0], x[:, 1]
        a = np.stack([_wrapped(u + v), (u + (p - v)) * w % p], axis=1)
    return a.reshape(n, columns)


def inverse_ntt(a: np.ndarray) -> np.ndarray:
    """What ntt() was given, from its bit-reversed frequencies."""
    n, columns = a.shape
    p = np.uint64(PRIME)
    for w in reversed(_twiddles(n, True)):
        half = len(w)
        x = a.reshape(-1, 2, half, columns)
        u, v = x[:, 0], x[:, 1] * w % p
        a = np.stack([_wrapped(u + v), _wrapped(u + (p - v))], axis=1)
    return a.reshape(n, columns) * np.uint64(pow(n, -1, PRIME)) % p


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of (block[j] - window[s + j]) ** 2 over j, for each shift s below the block's length.

    blocks is (b, columns) and windows (2 b, columns), of values up to 255; b is a power of two up to MAX_BLOCK.
    """
    b, columns = blocks.shape
    turned = np.zeros((2 * b, columns), np.uint64)
    turned[:b] = blocks[::-1]
    products = ntt(turned) * ntt(windows.astype(np.uint64)) % np.uint64(PRIME)
    shared = inverse_ntt(products)[b - 1 : 2 * b - 1].astype(np.int64)
    squares = np.zeros((2 * b + 1, columns), np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=0, out=squares[1:])
    return (blocks.astype(np.int64) ** 2).sum(axis=0) + squares[b : 2 * b] - squares[:b] - 2 * shared


def _gaps(keys: np.ndarray) -> np.ndarray:
    """How many words on each word comes again."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.full(len(keys), NEVER)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


class _Found:
    """Stretches found so far: start and end with the least distance."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}
        self.starts = self.reach = np.zeros(0, np.int64)

    def add(self, start: int, end: int, distance: int) -> None:
        self.period[start, end] = min(distance, self.period.get((start, end), distance))

    def settle(self) -> None:
        spans = sorted(self.period)
        self.starts = np.array([s for s, _ in spans], np.int64)
        self.reach = np.maximum.accumulate(np.array([e for _, e in spans], np.int64)) if spans else self.starts

    def inside(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each range lies in one of the settled stretches."""
        if not len(self.starts):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.starts, starts, "right")
        return (at > 0) & (self.reach[np.maximum(at - 1, 0)] >= ends)


def _seeds(scale: int, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and distances from scale to 2 * scale - 1 at which the codes of a block come again."""
    b = min(scale, MAX_BLOCK)
    found, distances = [], []
    for i in range(0, len(starts), max(1, TABLE // (2 * b))):
        own = starts[i : i + max(1, TABLE // (2 * b))]
        blocks = codes[own + np.arange(b)[:, None]]
        for first in range(scale, 2 * scale, b):
            at = own + first + np.arange(2 * b)[:, None]
            shift, column = np.nonzero(squared_differences(blocks, codes[np.minimum(at, len(codes) - 1)]) == 0)
            found.append(own[column])
            distances.append(shift + first)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found), np.concatenate(distances)) if found else (none, none)


def _matching(keys: np.ndarray, start: int, end: int, distance: int) -> int:
    """How many words from start on equal those that distance on, before end."""
    at, step = start, 64
    while at < end:
        to = min(end, at + step)
        differ = keys[at:to] != keys[at + distance : to + distance]
        if differ.any():
            return at + int(differ.argmax()) - start
        at, step = to, 4 * step
    return end - start


def _matching_back(keys: np.ndarray, start: int, first: int, distance: int) -> int:
    """How many words before start, down to first, equal those that distance on."""
    at, step = start, 64
    while at > first:
        to = max(first, at - step)
        differ = keys[to:at] != keys[to + distance : at + distance]
        if differ.any():
            return start - (to + int(np.flatnonzero(differ)[-1]) + 1)
        at, step = to, 4 * step
    return start - first


def find_runs(keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, length, period) of all runs, by row, start and period; keys stand for words, row i has those of bounds[i]:bounds[i + 1]."""
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = mix(keys ^ mix(rows + np.uint64(1)))  # words of different rows never match
    gaps, codes, found = _gaps(keys), (keys & np.uint64(255)).astype(np.uint8), _Found()
    scale, longest = 1, int(counts.max(initial=0))
    while LEAST_EXPONENT * scale <= longest and longest >= LEAST_WORDS:
        b = min(scale, MAX_BLOCK)
        blocks = np.where(counts >= LEAST_EXPONENT * scale, counts // scale - 1, 0)
        starts = np.repeat(bounds[:-1], blocks) + scale * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        alone = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(gaps >= 2 * scale, out=alone[1:])
        starts = starts[alone[starts + b] == alone[starts]]
        starts = starts[~found.inside(starts, starts + 3 * scale)]
        starts, distances = _seeds(scale, starts, codes)
        ends = bounds[np.searchsorted(bounds, starts, "right")]
        fits = starts + distances + b <= ends
        fits[fits] = (keys[starts[fits]] == keys[(starts + distances)[fits]]) & ~found.inside(starts[fits], (starts + distances)[fits] + b)
        starts, distances, ends = starts[fits], distances[fits], ends[fits]
        order = np.lexsort((starts, distances))
        last = (0, 0, 0)
        for s, d, end in zip(starts[order].tolist(), distances[order].tolist(), ends[order].tolist(), strict=True):
            if last[0] == d and last[1] <= s and s + d + b <= last[2]:
                continue
            on = _matching(keys, s, end - d, d)
            if on >= b:
                first = int(bounds[np.searchsorted(bounds, s, "right") - 1])
                low = s - _matching_back(keys, s, first, d)
                last = (d, low, s + on + d)
                found.add(low, s + on + d, d)
        found.settle()
        scale *= 2
    out = []
    for (start, end), q in found.period.items():
        if end - start >= max(LEAST_WORDS, LEAST_EXPONENT * q):
            row = int(np.searchsorted(bounds, start, "right")) - 1
            out.append((row, start - int(bounds[row]), end - start, q))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def runs_of(words: Words, texts: Sequence[str | None]) -> tuple[list[list[tuple[int, int, int]]], list[list[bytes]]]:
    """(start, length, period) of all runs of each text, and its words."""
    own = [(t or "").encode().split() for t in texts]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in own]
    for row, *run in find_runs(words.hashes, words.bounds):
        runs[row].append(tuple(run))
    for i, (spans, w) in enumerate(zip(runs, own, strict=True)):
        if any(w[s : s + n - q] != w[s + q : s + n] for s, n, q in spans):  # two words with one hash
            number: dict[bytes, int] = {}
            exact = np.array([number.setdefault(x, len(number)) for x in w], np.uint64)
            runs[i] = [tuple(run) for _, *run in find_runs(exact, np.array([0, len(w)]))]
    return runs, own


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first, then that of the smaller period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_words, runs (start in words, length, period; by start, then period), best, and collapsed.

    best is the run with the greatest length / period; collapsed is the text without the
    words that any run holds after its first period, the others joined by one space.
    """
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def prepare():
        def named(run: tuple[int, int, int]) -> dict[str, int]:
            return dict(zip(("start", "length", "period"), run, strict=True))

        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            words = words_of(texts, SPACE_SEPARATED)
            runs, own = runs_of(words, texts.to_pylist())
            collapsed = []
            for spans, w in zip(runs, own, strict=True):
                if spans:
                    edges = np.zeros(len(w) + 1, np.int64)
                    for s, n, q in spans:
                        edges[s + q] += 1
                        edges[s + n] -= 1
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
                collapsed.append(b" ".join(w).decode())
            best = [best_of(spans) for spans in runs]
            return [
                pa.array(words.counts, pa.int64()),
                pa.array([[named(run) for run in spans] for spans in runs], pa.list_(kind)),
                pa.array([named(run) if run else None for run in best], kind),
                pa.array(collapsed),
            ]

        return make

    return map_texts(docs, text, list(keep), f"n_words long, runs array<{RUN}>, best {RUN}, collapsed string", prepare)
