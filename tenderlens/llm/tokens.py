"""Vectorised word splitting and hashing of Arrow string columns.

A batch of texts is one byte buffer.  Words are maximal runs of bytes that a
256-entry table marks as word bytes, and a word's 64-bit hash is a polynomial
over per-byte random values, read off one running sum, so that no word ever
becomes a Python object.  UTF-8 bytes above 0x7F never collide with ASCII
separators, hence byte classes express the character classes exactly.

Nulls and empty texts have no words.  A hash stands for a word wherever
billions of words meet; operators that promise exact results verify spans or
accept the 2**-64 collision odds, and say which.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_FOLD = np.arange(256)
_FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _PowerTable:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = _powers(_BASE, 1024)
    down = _powers(_INVERSE, 1024)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << int(n).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a batch: hash, byte range in `data`, and rows' word ranges.

    Row i has the words bounds[i]:bounds[i + 1] and the bytes offsets[i]:offsets[i + 1].
    """

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes that stay within a row, and row bounds."""
    mask = inside[data]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = mask[cuts]
    last[cuts - 1] = mask[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-dependent 64-bit hash of values[s:e] for each range, all from one running sum."""
    up, down = _PowerTable.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def row_hashes(values: np.ndarray, bounds: np.ndarray, stretch: int = 1 << 17) -> np.ndarray:
    """Order-dependent 64-bit hash of every row's values; a row longer than a stretch is the sequence of its stretches' hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + stretch, "right")) - 1)
        own = values[bounds[i] : bounds[j]]
        if len(own) > stretch:
            parts = [range_hashes(p, np.array([0]), np.array([len(p)])) for p in np.split(own, range(stretch, len(own), stretch))]
            out[i] = range_hashes(np.concatenate(parts), np.array([0]), np.array([len(parts)]))[0]
        else:
            out[i:j] = range_hashes(own, bounds[i:j] - bounds[i], bounds[i + 1 : j + 1] - bounds[i])
        i = j
    return out


def words_of(column: pa.Array | pa.ChunkedArray, inside: np.ndarray = SPACE_SEPARATED, fold: bool = False) -> Words:
    """Words of every row; fold lower-cases A-Z, and only those."""
    data, offsets = text_buffer(column)
    starts, ends, bounds = spans_of(data, offsets, inside)
    table = _RANDOM[_FOLD] if fold else _RANDOM
    out = np.empty(len(starts), np.uint64)
    # the power table stays small when hashing goes through bounded stretches of words
    for i in range(0, len(starts), 1 << 17):
        j = min(len(starts), i + (1 << 17))
        base = starts[i]
        out[i:j] = range_hashes(table[data[base : ends[j - 1]]], starts[i:j] - base, ends[i:j] - base)
    return Words(out, starts, ends, bounds, data, offsets)


def prefix_hashes(words: Words, size: int, fold: bool = False) -> np.ndarray:
    """Hash of each word's first `size` bytes (of the whole word if it is no longer)."""
    table = _RANDOM[_FOLD] if fold else _RANDOM
    out = np.empty(len(words.starts), np.uint64)
    for i in range(0, len(out), 1 << 17):
        j = min(len(out), i + (1 << 17))
        base, starts = words.starts[i], words.starts[i:j]
        ends = np.minimum(starts + size, words.ends[i:j])
        out[i:j] = range_hashes(table[words.data[base : words.ends[j - 1]]], starts - base, ends - base)
    return out


def suffix_hashes(words: Words, size: int, fold: bool = False) -> np.ndarray:
    """Hash of each word's last `size` bytes (of the whole word if it is no longer)."""
    table = _RANDOM[_FOLD] if fold else _RANDOM
    out = np.empty(len(words.starts), np.uint64)
    for i in range(0, len(out), 1 << 17):
        j = min(len(out), i + (1 << 17))
        base, ends = words.starts[i], words.ends[i:j]
        starts = np.maximum(ends - size, words.starts[i:j])
        out[i:j] = range_hashes(table[words.data[base : words.ends[j - 1]]], starts - base, ends - base)
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one sequence; empty when it is shorter."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = 1 << 17
    up, down = _PowerTable.upto(min(n, step) + k)
    for i in range(0, n, step):
        j = min(n, i + step)
        total = np.zeros(j - i + k, np.uint64)
        np.cumsum(hashes[i : j + k - 1] * up[: j - i + k - 1], out=total[1:])
        out[i:j] = mix((total[k:] - total[:-k]) * down[: j - i] + np.uint64(k))
    return out


def whole_windows(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions (in the batch's word sequence) at which k words of one row begin."""
    n = int(bounds[-1])
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = bounds[1:] - back
        ok[at[at >= bounds[:-1]]] = False
    return np.flatnonzero(ok)
