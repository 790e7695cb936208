"""LM scoring with a hashed maximum-entropy model.

A word's probability is P(class | history) * P(word | class).  The first factor
is a softmax over `CLASSES` whose logits sum weights of hashed history features:
the word before (bigram), the two before (trigram), and the second and third
before alone (skips).  The most frequent words are classes of their own, others
fall into classes by their last bytes.  The second factor is the maximum-entropy
distribution with word frequency as its feature, P = (c + 0.1) / (N + 0.1 * (V + 1))
within the class, so unseen words keep mass and all outcomes sum to 1.

The model grows with the corpus: weight rows with the square root of the training
tokens (`weight_rows`), up to 2**18 rows, which is what a broadcast may hold; a
quarter as many of the most frequent words are told apart in histories, others by
their last bytes; word counts are kept for all words.

Training: word counts come from all training texts through a shuffle.  Weights
come from `ROUNDS` distributed updates; in each, every task takes gradient steps
over its share of the texts (every training text serves in exactly one round)
from the weights broadcast to it, and row-wise averages weighted by
observations, formed in two grouped levels, are the next weights.  Texts are dealt
to groups by a hash of id and text and read in its order; how many groups there are
follows from the token count, about `TEXT_PER_WEIGHT` bytes of text for each byte of
weights that one may send.  Such a group sends its weights once, whatever partition it
is in, so scores do not depend on how the input or the shuffle is partitioned.

Scoring: frequent words (at most `head` of them) are broadcast with their
counts; counts of all other words meet the documents that hold them in a join.

Defined results: null and empty texts are one end token; texts repeated in
several rows score alike; null ids are held out (crc32 of an empty text is 0);
an empty training set leaves uniform classes and N = V = 0; an empty table
gives an empty result; very long texts are scored whole, in pieces of bounded
size.  Only the id and the text are read, so docs' further columns, whatever
their names, change nothing.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import TEXT, column, lists, map_texts, pieces
from .cluster import written
from .tokens import SPACE_SEPARATED, Words, mix, row_hashes, suffix_hashes, words_of

SINGLES = 32
SUFFIX_CLASSES = 32
CLASSES = SINGLES + SUFFIX_CLASSES
LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18
ROWS_PER_UNIT = 4
TEXT_PER_WEIGHT = 4
BLOCK = 128
ROUNDS = 3
CHUNK = 1 << 15
STRIP = 1 << 10
KINDS = 4
LIMIT = 15.0
PRIOR = 20.0
STEP = 0.35
SLOTS = 4096
SMOOTH = 0.1
END = np.uint64(0xA5A5_1234_5678_9ABD)
END_CLASS = 0


class Tokens:
    """Hashes, suffix classes and row bounds of a piece's tokens: words, then one end per text."""

    def __init__(self, texts: pa.Array) -> None:
        words = words_of(texts, SPACE_SEPARATED, fold=True)
        n = len(words.counts)
        self.bounds = words.bounds + np.arange(n + 1)
        self.hashes = np.full(int(self.bounds[-1]), END, np.uint64)
        self.suffix = np.full(len(self.hashes), END_CLASS, np.int64)
        place = np.arange(len(words.hashes)) + words.rows()
        self.hashes[place] = words.hashes
        self.suffix[place] = (suffix_hashes(words, 2, fold=True) % np.uint64(SUFFIX_CLASSES)).astype(np.int64)
        self.words: Words = words

    def history(self, units: np.ndarray, start: int, back: int) -> np.ndarray:
        """The unit `back` tokens before each token, or `start` where the text begins."""
        out = np.full(len(units), start, np.int64)
        out[back:] = units[:-back] if back < len(units) else out[back:]
        for k in range(back):
            at = self.bounds[:-1] + k
            out[at[at < self.bounds[1:]]] = start
        return out


def weight_rows(tokens: int) -> int:
    """Weight rows for a corpus of that many training tokens: a power of two near twice the square root."""
    return int(min(MOST_ROWS, max(LEAST_ROWS, 1 << round(np.log2(2 * max(tokens, 1) ** 0.5)))))


class HashIndex:
    """Positions of 64-bit hashes in an array, by open addressing on their leading bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.append(hashes, np.uint64(0))
        bits = max(4, int(len(hashes) * 3).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, len(hashes), np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        at = (hashes >> self.shift).astype(np.int64)
        self.reach = 0
        while len(left):
            self.reach += 1
            free = self.slots[at] == len(hashes)
            self.slots[at[free]] = left[free]  # of several, the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.last

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        at = (hashes >> self.shift).astype(np.int64)
        out = self.slots[at]
        none = len(self.hashes) - 1
        left = np.flatnonzero((out != none) & (self.hashes[out] != hashes))
        for k in range(1, self.reach):
            if not len(left):
                break
            found = self.slots[(at[left] + k) & self.last]
            out[left] = found
            left = left[(found != none) & (self.hashes[found] != hashes[left])]
        out[left] = none
        return np.where(out == none, -1, out)


class Vocabulary:
    """Frequent words by hash, most frequent first: those told apart in histories (`units`) and those that are classes of their own."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, rows: int) -> None:
        order = np.lexsort((hashes, -counts))
        self.hashes, self.counts = hashes[order], counts[order].astype(np.float64)
        self.rows, self.units = rows, rows // ROWS_PER_UNIT
        self.index = HashIndex(self.hashes)

    def head(self) -> Vocabulary:
        """What training needs: the units."""
        return Vocabulary(self.hashes[: self.units], self.counts[: self.units], self.rows)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash, or -1."""
        return self.index.find(hashes)

    def classes(self, tokens: Tokens, rank: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < SINGLES), rank, SINGLES + tokens.suffix)

    def features(self, tokens: Tokens, rank: np.ndarray) -> np.ndarray:
        """A (KINDS, tokens) table of weight rows."""
        units = np.where((rank >= 0) & (rank < self.units), rank, self.units + tokens.suffix)
        start = self.units + SUFFIX_CLASSES
        one, two, three = (tokens.history(units, start, k).astype(np.uint64) for k in (1, 2, 3))
        wide = np.uint64(1 << 20)
        keys = (one, two + wide, three + wide * np.uint64(2), one * wide + two + wide * wide)
        return np.stack([(mix(k) % np.uint64(self.rows)).astype(np.int32) for k in keys])


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Sums of the rows' weights, in `out`; LIMIT on each weight keeps their exponentials within single precision."""
    np.take(weights, rows[0], axis=0, out=out, mode="clip")
    for r in rows[1:]:
        out += np.take(weights, r, axis=0, mode="clip")
    out += bias
    return out


def log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of each token's class probability."""
    out, ones = np.empty(len(classes)), np.ones(CLASSES, np.float32)
    space = np.empty((STRIP, CLASSES), np.float32)
    for i in range(0, len(classes), STRIP):
        own = classes[i : i + STRIP]
        z = logits(weights, bias, rows[:, i : i + STRIP], space[: len(own)])
        chosen = z[np.arange(len(own)), own]
        out[i : i + STRIP] = chosen - np.log(np.exp(z, out=z) @ ones)
    return out


def slopes(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Probability of each class less 1 for the true one, by token; one row of zeros is appended."""
    out, ones = np.zeros((len(classes) + 1, CLASSES), np.float32), np.ones(CLASSES, np.float32)
    for i in range(0, len(classes), STRIP):
        own = classes[i : i + STRIP]
        z = logits(weights, bias, rows[:, i : i + STRIP], out[i : i + len(own)])
        np.exp(z, out=z)
        z /= (z @ ones)[:, None]
        z[np.arange(len(own)), own] -= 1
    return out


def sums_of(values: np.ndarray, order: np.ndarray, sizes: np.ndarray, halvings: int = 3) -> np.ndarray:
    """Sums of runs of values[order], `sizes` long; values ends with a row of zeros.

    Runs are halved by adding neighbours, a few whole-array steps that leave few rows for the last sum.
    """
    for _ in range(halvings):
        ends = np.cumsum(sizes)
        half = (sizes + 1) // 2
        inside = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)
        left = np.repeat(ends - sizes, half) + 2 * inside
        right = np.where(left + 1 < np.repeat(ends, half), left + 1, len(order))
        order = np.append(order, len(values) - 1)
        added = np.zeros((len(left) + 1, values.shape[1]), values.dtype)
        np.take(values, order[left], axis=0, out=added[:-1], mode="clip")
        added[:-1] += np.take(values, order[right], axis=0, mode="clip")
        values, order, sizes = added, np.arange(len(left)), half
    return np.add.reduceat(values[:-1], np.cumsum(sizes) - sizes, axis=0)


def learn(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, rows: np.ndarray, classes: np.ndarray, scale: np.ndarray) -> None:
    """One gradient step over a chunk, in place; seen counts observations per weight row."""
    slope = slopes(weights, bias, rows, classes)
    for r in rows:
        order = np.argsort(r)
        r = r[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        which, n = r[first], np.diff(np.append(first, len(r)))
        seen[which] += n
        grad = sums_of(slope, order, n)
        moved = weights[which] - STEP * grad / (seen[which][:, None] * scale + np.float32(PRIOR * scale.mean()))
        weights[which] = np.clip(moved, -LIMIT, LIMIT)


def training(docs: DataFrame, id_col: str, text: str, mod: int) -> DataFrame:
    return docs.where(~held_out(id_col, mod)).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias(TEXT))


def held_out(id_col: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == 0


def merged(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """(hash, suffix class, count) parts as one with each hash once."""
    h, s, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    h, s, c = h[order], s[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return [(h[first], s[first], np.add.reduceat(c, first))]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, suffix, n) over all texts of rows; each task sums its own share before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for piece in pieces(batch):
                tokens = Tokens(piece.column(1).cast(pa.string()))
                h, at, c = np.unique(tokens.hashes, return_index=True, return_counts=True)
                parts.append((h, tokens.suffix[at], c))
                size += len(h)
                if size > 4_000_000:
                    parts = merged(parts)
                    size = len(parts[0][0])
                    if size > 3_000_000:  # a task's own sums stay bounded; the shuffle adds what it emits
                        yield from emit(parts)
                        parts, size = [], 0
        if parts:
            yield from emit(merged(parts))

    def emit(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        for h, s, c in parts:
            for i in range(0, len(h), 100_000):
                j = i + 100_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[i:j].view(np.int64)), pa.array(s[i:j].astype(np.int8)), pa.array(c[i:j].astype(np.int64))],
                    ["word", "suffix", "n"],
                )

    return rows.mapInArrow(run, "word long, suffix byte, n long").groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))


def frequent(counts: DataFrame, head: int) -> list[np.ndarray]:
    """Hashes, suffix classes and counts of the `head` most frequent words.

    Words are taken by levels of frequency, and of the level that no longer fits whole by
    ranges of a hash, so that ties of any size leave less than a range unused.
    """
    level, slot = F.floor(F.log2("n") * 64).cast("int"), F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int")
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)  # at most 64 * 63 rows
    total, least, cut = 0, 1 << 30, None
    for value, n in levels:
        if total + n > head:
            cut = value
            break
        total, least = total + n, value
    wanted = level >= least
    if cut is not None:
        last = 0
        for value, n in sorted((r[0], r[1]) for r in counts.where(level == cut).groupBy(slot).count().collect()):  # SLOTS rows at most
            if total + n > head:
                break
            total, last = total + n, value + 1
        wanted = wanted | ((level == cut) & (slot < last))
    table = counts.where(wanted).toArrow()
    h, s, c = (table[x].to_numpy() for x in ("word", "suffix", "n"))
    return [h.view(np.uint64), s.astype(np.int64), c]


class Share:
    """A group's own weights, moved by `CHUNK` tokens at a time wherever its rows are cut into pieces."""

    def __init__(self, start: np.ndarray, bias: np.ndarray, scale: np.ndarray) -> None:
        self.start, self.bias, self.scale = start, bias, scale
        self.own, self.seen = start.copy(), np.zeros(len(start), np.float32)
        self.features, self.classes = np.zeros((KINDS, 0), np.int64), np.zeros(0, np.int64)

    def take(self, features: np.ndarray, classes: np.ndarray, whole: bool = True) -> None:
        """Steps over what is held and these tokens; with `whole`, what fills no chunk waits."""
        features, classes = np.concatenate([self.features, features], axis=1), np.concatenate([self.classes, classes])
        end = len(classes) // CHUNK * CHUNK if whole else len(classes)
        for i in range(0, end, CHUNK):
            at = slice(i, min(i + CHUNK, end))
            learn(self.own, self.bias, self.seen, features[:, at], classes[at], self.scale)
        self.features, self.classes = features[:, end:].copy(), classes[end:].copy()

    def moved(self, group: int) -> Iterator[pa.RecordBatch]:
        """Per block of weight rows that the group has seen, moves times observations, and observations."""
        self.take(self.features[:, :0], self.classes[:0], whole=False)
        own, start, seen = self.own, self.start, self.seen
        used = np.flatnonzero(seen.reshape(-1, BLOCK).any(1)).tolist()
        for i in range(0, len(used), 64):
            part = used[i : i + 64]
            packed = []
            for b in part:
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                packed.append(np.column_stack([(own[at] - start[at]) * seen[at, None], seen[at]]).astype(np.float32).tobytes())
            columns = [pa.array(part, pa.int32()), pa.array([group] * len(part), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "moved"])


def step(rows: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, bias: np.ndarray, fan: int) -> np.ndarray:
    """Weights after every group's own gradient steps over its texts, averaged row by row.

    A partition holds whole groups, one after the other, and sends weights once for each.
    """
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start, bias = shared.value
        p = np.exp(bias)
        scale = (p * (1 - p) + 1e-4).astype(np.float32)
        group, share = -1, None
        for batch in batches:
            groups = column(batch, "group").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for at, to in zip(cuts[:-1], cuts[1:], strict=True):
                if to > at and groups[at] != group:
                    if share is not None:
                        yield from share.moved(group)
                    group, share = int(groups[at]), Share(start, bias, scale)
                for piece in pieces(batch.slice(at, to - at)):
                    tokens = Tokens(column(piece, TEXT).cast(pa.string()))
                    rank = vocabulary.find(tokens.hashes)
                    share.take(vocabulary.features(tokens, rank), vocabulary.classes(tokens, rank))
        if share is not None:
            yield from share.moved(group)

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # sums of floats depend on the order
        sums = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["moved"])
        return pa.table({
            "block": table["block"].slice(0, 1),
            "part": table["part"].slice(0, 1),
            "moved": pa.array([sums.astype(np.float32).tobytes()], pa.binary()),
        })

    kind = "block int, part int, moved binary"
    parts = rows.mapInArrow(run, kind).groupBy("block", F.pmod("part", F.lit(fan))).applyInArrow(lambda _, table: total(table), kind)
    parts = parts.groupBy("block").applyInArrow(total, kind)
    out = weights.copy()
    for block, _, moved in parts.toLocalIterator():  # the weights, MOST_ROWS * CLASSES numbers at most, by partitions
        table = np.frombuffer(bytes(moved), np.float32).reshape(BLOCK, CLASSES + 1)
        out[block * BLOCK : (block + 1) * BLOCK] += table[:, :CLASSES] / np.maximum(table[:, CLASSES:], 1)
    return out


class Model:
    """All that scoring broadcasts: bounded by `head`, MOST_ROWS and CLASSES."""

    def __init__(
        self, vocabulary: Vocabulary, weights: np.ndarray, bias: np.ndarray, total: int, distinct: int, class_total: np.ndarray, class_distinct: np.ndarray
    ) -> None:
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias
        self.total, self.distinct = total, distinct
        self.base = np.log10(total + SMOOTH * (distinct + 1))
        self.inside = np.log10(class_total + SMOOTH * (class_distinct + 1))


def train(docs: DataFrame, counts: DataFrame, text: str, id_col: str, mod: int, head: int) -> Model:
    h, s, c = frequent(counts, head)
    sums = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        tokens[SINGLES + r.suffix], words[SINGLES + r.suffix] = r.n, r.v
    total, distinct = int(tokens.sum()), int(words.sum())
    vocabulary = Vocabulary(h, c, weight_rows(total))
    own = np.lexsort((h, -c))[:SINGLES]
    for rank, i in enumerate(own.tolist()):
        tokens[rank], words[rank] = c[i], 1
        tokens[SINGLES + s[i]] -= c[i]
        words[SINGLES + s[i]] -= 1
    bias = np.log((tokens + 1) / (tokens + 1).sum()).astype(np.float32)
    weights = np.zeros((vocabulary.rows, CLASSES), np.float32)
    rows = training(docs, id_col, text, mod)
    rows = rows.select(*rows.columns, F.xxhash64(*rows.columns).alias("place"))
    bytes_read = total * 6  # a word and its separator
    tasks = int(max(1, bytes_read // (TEXT_PER_WEIGHT * weights.nbytes)))
    rows = rows.withColumn("group", F.pmod("place", F.lit(tasks)).cast("int"))
    known = vocabulary.head()
    for k in range(ROUNDS):
        share = rows.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k).repartitionById(tasks, "group")
        weights = step(share.sortWithinPartitions("group", "place", "id"), known, weights, bias, max(1, int(tasks**0.5)))
    return Model(vocabulary, weights, bias, total, distinct, tokens, words)


PARTIAL = "key long, n_tokens long, known long, head_log double, class_log double, rest array<long>, rest_n array<int>"


def partial_scores(docs: DataFrame, model: Model, text: str, id_col: str) -> DataFrame:
    """Per row what the broadcast model knows: the frequent words' share of both scores, and the other words with their frequency."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        model = shared.value
        vocabulary = model.vocabulary
        logs = np.log10(vocabulary.counts + SMOOTH)

        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            tokens = Tokens(texts)
            n, bounds = len(tokens.hashes), tokens.bounds
            rank = vocabulary.find(tokens.hashes)
            features, classes = vocabulary.features(tokens, rank), vocabulary.classes(tokens, rank)
            chosen = log_probabilities(model.weights, model.bias, features, classes)
            single = classes < SINGLES
            chosen = chosen / np.log(10) - np.where(single, 0, model.inside[classes])
            head = rank >= 0
            log_count = np.where(head, logs[rank], 0.0) if len(logs) else np.zeros(n)
            # a word that is a class of its own has no second factor, so its count leaves the sum that both scores share
            chosen -= np.where(single, log_count, 0)
            starts = bounds[:-1]
            out = np.flatnonzero(~head)
            row = np.searchsorted(bounds, out, "right") - 1
            order = np.lexsort((tokens.hashes[out], row))
            h, r = tokens.hashes[out[order]], row[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
            rest_bounds = np.searchsorted(r[first], np.arange(len(starts) + 1))
            keys = row_hashes(tokens.hashes, bounds)
            sums = [np.add.reduceat(x, starts) if n else np.zeros(0) for x in (head.astype(np.int64), log_count, chosen)]
            times = np.diff(np.append(first, len(h))).astype(np.int32)
            rest = [lists(h[first].view(np.int64), rest_bounds), lists(times, rest_bounds)]
            return [pa.array(keys.view(np.int64)), pa.array(np.diff(bounds)), *map(pa.array, sums), *rest]

        return make

    return map_texts(docs, text, [id_col], PARTIAL, prepare)


def lm_scores(docs: DataFrame, text: str = "text", id_col: str = "doc_id", mod: int = 10, head: int = 1 << 18) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    counts = written(word_counts(training(docs, id_col, text, mod)))
    model = train(docs, counts, text, id_col, mod, head)
    partial = written(partial_scores(docs, model, text, id_col))
    # rows with equal words share a key; one of them sends its words
    once = partial.where(F.size("rest") > 0).groupBy("key").agg(F.first(F.struct("rest", "rest_n")).alias("w"))
    pairs = once.select("key", F.explode(F.arrays_zip("w.rest", "w.rest_n")).alias("w")).select(
        "key",
        F.col("w.rest").alias("word"),
        F.col("w.rest_n").alias("times"),
    )
    rare = pairs.join(counts.select("word", "n"), "word", "left")
    seen = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10(seen + SMOOTH)).alias("rest_log"),
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    out = partial.drop("rest", "rest_n").join(rare, "key", "left").na.fill(0, ["rest_log", "rest_known"])
    both = F.col("head_log") + F.col("rest_log")
    return out.select(
        id_col,
        held_out(id_col, mod).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rest_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (both - F.col("n_tokens") * float(model.base)).alias("base_score"),
        (both + F.col("class_log")).alias("score"),
    )
