"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences (runs between . ! ? and line ends).  A
sentence's probability is logistic in the sum of weights of its distinct
words, where a word has a hashed weight of its own and one for each of several
prefixes; a document's is the noisy-or of its sentences', so labels of
documents teach which sentences offend.  Sentences without any telling word are a
text's background: together they count like the logarithm of their number of plain
sentences, so that clean texts do not grow toxic with their length.  Only the text
enters a score.

Training reads at most `max_rows` labelled rows of either label, the smallest
by a hash of their id, weighted back to the labels' true shares.  Tasks count
features and reduce texts to the sentences that hold a telling one; only these
numbers, no texts, meet in the task that descends the gradient.  Scoring runs
over every text, in Arrow batches.

Defined results: null and empty texts have no sentence and score 0; very long
texts are scored whole; labels that disagree on one id count as toxic, null labels
and labels without an id are ignored; without any usable label all scores are 0;
rows that repeat an id train and score each by its own text; repeated rows score
alike.  New columns replace input columns of their names (see `prefix`); others
are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import TEXT, column, lists, map_texts, pieces
from .cluster import written
from .tokens import ALPHANUMERIC, Words, mix, prefix_hashes, words_of

BITS = 18
PREFIXES = (4, 5, 6, 7, 8)
START_BIAS = -6.0
SENTENCE_ENDS = np.array([x in b".!?\n" for x in range(256)])
SCORES = ("score double", "predicted int", "offending array<string>", "offending_scores array<double>")


def held_out(id_col: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == 0


def sentences_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sentence number of each word, and each row's range of sentence numbers; sentences without words have no number."""
    marks = np.concatenate([[0], np.cumsum(SENTENCE_ENDS[words.data])])
    part = marks[words.starts]
    rows = words.rows()
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (rows[1:] != rows[:-1])
    number = np.cumsum(fresh) - 1
    first_row = rows[fresh]
    return number, np.searchsorted(first_row, np.arange(len(words.bounds)))


def features(words: Words) -> np.ndarray:
    """A (features, words) table of weight numbers."""
    shift = np.uint64(64 - BITS)
    kinds = [words.hashes, *(prefix_hashes(words, k) for k in PREFIXES)]
    return np.stack([(mix(h + np.uint64(i)) >> shift).astype(np.int64) for i, h in enumerate(kinds)])


def distinct(words: Words, number: np.ndarray) -> np.ndarray:
    """Positions of each word's first occurrence in its sentence."""
    return np.unique(mix(words.hashes + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]


def noisy_or(z: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence probabilities, and each row's log probability that no sentence is positive."""
    none = -np.logaddexp(0, z)
    total = np.concatenate([[0.0], np.cumsum(none)])
    return -np.expm1(none), total[ranges[1:]] - total[ranges[:-1]]


def feature_counts(words: Words, number: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows, and in how many toxic ones, each feature occurs."""
    size = 1 << BITS
    seen, toxic = np.zeros(size), np.zeros(size)
    at = np.sort(distinct(words, number))
    rows = words.rows()[at]
    for f in features(words)[:, at]:
        pair = np.unique(rows * np.int64(size) + f)
        row, feature = pair // size, pair % size
        seen += np.bincount(feature, minlength=size)
        toxic += np.bincount(feature, labels[row], size)
    return seen, toxic


def telling(seen: np.ndarray, toxic: np.ndarray, share: float, least_z: float) -> np.ndarray:
    """Features that occur in clearly more toxic rows than their frequency explains; rare chance companions of one label do not pass.

    Counts are of sample rows without weights, since chance is the sample's: a row's weight is no further evidence.
    """
    expected = seen * share
    return (toxic - expected) / np.sqrt(expected * (1 - share) + 0.5) >= least_z


def background(n: np.ndarray) -> np.ndarray:
    """How many plain sentences n sentences without a telling word count for."""
    return np.log1p(n)


def reduced(
    words: Words, number: np.ndarray, ranges: np.ndarray, chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row its number of sentences without a chosen feature; of the others (sentence, feature) pairs, their row bounds, and their number.

    Sentences count from 0 in each row; features are places in `chosen`.
    """
    at = np.sort(distinct(words, number))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    index = place[features(words)[:, at]]
    kind, word = np.nonzero(index >= 0)
    order = np.argsort(word, kind="stable")
    feature, sentence = index[kind[order], word[order]], number[at][word[order]]
    active, local = np.unique(sentence, return_inverse=True)
    row_of = np.searchsorted(ranges, active, "right") - 1
    n_active = np.bincount(row_of, minlength=len(ranges) - 1)
    first = np.concatenate([[0], np.cumsum(n_active)])
    pair_row = row_of[local] if len(active) else np.zeros(0, np.int64)
    bounds = np.searchsorted(pair_row, np.arange(len(ranges)))
    return np.diff(ranges) - n_active, local - first[pair_row], feature, bounds, n_active


def descend(
    labels: np.ndarray,
    weights: np.ndarray,
    plain: np.ndarray,
    sentence: np.ndarray,
    feature: np.ndarray,
    row: np.ndarray,
    k: int,
    epochs: int,
    rate: float,
    decay: float,
) -> tuple[np.ndarray, float]:
    """Weights of the k features and the bias, by AdaGrad on the noisy-or likelihood; row: of each sentence that has a feature, plain: how many others a row has."""
    plain = background(plain)
    w, bias, seen, seen_bias = np.zeros(k), START_BIAS, np.full(k, 1e-2), 1e-2
    scale = weights * len(labels) / max(weights.sum(), 1e-9)
    for _ in range(epochs if len(row) or plain.any() else 0):
        none = -np.logaddexp(0, np.bincount(sentence, w[feature], len(row)) + bias)
        none_plain = -np.logaddexp(0, bias)
        total = np.minimum(np.bincount(row, none, len(labels)) + plain * none_plain, -1e-9)
        up = np.where(labels > 0, np.exp(total) / -np.expm1(total), -1.0) * scale  # (1 - P) / P for toxic rows
        slope = -np.expm1(none) * up[row]
        grad = np.bincount(feature, slope[sentence], k) - decay * w
        seen += grad**2
        slope_bias = slope.sum() + (up * plain).sum() * -np.expm1(none_plain)
        seen_bias += slope_bias**2
        w += rate * grad / np.sqrt(seen)
        bias += rate * slope_bias / np.sqrt(seen_bias)
    return w, bias


def numbered(sentence: np.ndarray, n_active: np.ndarray, n_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentences numbered over all rows, and the row of each."""
    first = np.cumsum(n_active) - n_active
    return sentence + np.repeat(first, n_pairs), np.repeat(np.arange(len(n_active)), n_active)


LEAST_Z = 5.0


def parsed(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    words = words_of(pc.utf8_lower(texts.fill_null("")), ALPHANUMERIC)
    return words, *sentences_of(words)


def packed(chosen: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1)
    out[chosen], out[-1] = w, bias
    return out


def fit(texts: pa.Array, labels: np.ndarray, weights: np.ndarray, epochs: int = 60, rate: float = 0.3, decay: float = 0.1, least_z: float = LEAST_Z) -> np.ndarray:
    """Weights and, last, the bias, from texts that are all at hand."""
    words, number, ranges = parsed(texts)
    chosen = np.flatnonzero(telling(*feature_counts(words, number, labels), labels.mean() if len(labels) else 0.0, least_z))
    plain, sentence, feature, bounds, n_active = reduced(words, number, ranges, chosen)
    sentence, row = numbered(sentence, n_active, np.diff(bounds))
    return packed(chosen, *descend(labels, weights, plain, sentence, feature, row, len(chosen), epochs, rate, decay))


def training_rows(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, mod: int, max_rows: int) -> DataFrame:
    """(text, label, weight) of at most max_rows rows of either label, none of them held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, mod))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("__label"))
    parts = []
    for value in (0, 1):
        own = known.where(F.col("__label") == value)
        n = own.count()
        chosen = own.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(max_rows)
        parts.append(chosen.withColumn("__weight", F.lit(n / max(1, min(n, max_rows)))))
    chosen = F.broadcast(parts[0].union(parts[1]))  # 2 * max_rows rows at most
    return docs.select(F.col(id_col).alias("__id"), F.col(text).alias(TEXT)).join(chosen, "__id")


REDUCED = "__id string, __label int, __weight double, plain long, active long, sentence array<int>, feature array<int>"


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", mod: int = 5, max_rows: int = 4000, epochs: int = 60) -> np.ndarray:
    rows = training_rows(docs, labels, text, id_col, label, mod, max_rows)
    rows = written(rows.select(F.col("__id").cast("string").alias("__id"), "__label", "__weight", TEXT))  # the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                label = column(piece, "__label").to_numpy(zero_copy_only=False)
                words, number, _ = parsed(column(piece, TEXT).cast(pa.string()))
                seen, toxic = feature_counts(words, number, label)
                used = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(used, -1)), pa.array(np.append(seen[used], len(label))), pa.array(np.append(toxic[used], float(label.sum())))],
                    ["feature", "seen", "toxic"],
                )

    counts = rows.mapInArrow(count, "feature long, seen double, toxic double").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    counts = counts.toArrow()  # 2 ** BITS rows at most
    feature, seen, toxic = (counts[c].to_numpy() for c in ("feature", "seen", "toxic"))
    whole = feature < 0
    if not whole.any():
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[-1] = -np.inf  # nothing was learnt: no sentence is toxic
        return w
    chosen = np.sort(feature[telling(seen, toxic, float(toxic[whole][0] / seen[whole][0]), LEAST_Z) & ~whole])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words, number, ranges = parsed(column(piece, TEXT).cast(pa.string()))
                plain, sentence, feature, bounds, n_active = reduced(words, number, ranges, chosen)
                kept = [column(piece, c) for c in ("__id", "__label", "__weight")]
                made = [pa.array(plain), pa.array(n_active), lists(sentence.astype(np.int32), bounds), lists(feature.astype(np.int32), bounds)]
                yield pa.RecordBatch.from_arrays([*kept, *made], ["__id", "__label", "__weight", "plain", "active", "sentence", "feature"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = [(c, "ascending") for c in ("__id", "__label", "plain", "active")]
        table = table.sort_by(order)
        labels, weights, plain, n_active = (table[c].to_numpy() for c in ("__label", "__weight", "plain", "active"))
        sentence, feature = (table[c].combine_chunks() for c in ("sentence", "feature"))
        n_pairs = sentence.value_lengths().to_numpy(zero_copy_only=False)
        sentence, row = numbered(sentence.flatten().to_numpy(zero_copy_only=False), n_active, n_pairs)
        w = packed(chosen, *descend(labels, weights, plain, sentence, feature.flatten().to_numpy(zero_copy_only=False), row, len(chosen), epochs, 0.3, 0.1))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    found = rows.mapInArrow(reduce, REDUCED).repartition(1).mapInArrow(run_or_none(run), "w binary").collect()
    return np.frombuffer(bytes(found[0][0]), np.float32)


def run_or_none(run):
    """run, for partitions that may have no batch at all."""

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        return run(iter(kept)) if kept else iter(())

    return guarded


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None, locate: float = 0.5, prefix: str = "") -> DataFrame:
    """Columns `keep` (default: all) with score, predicted, and the sentences that score `locate` or more.

    The new columns' names begin with prefix and replace columns of those names.
    """
    ddl = ", ".join(prefix + c for c in SCORES)
    made = {c.split()[0] for c in ddl.split(", ")}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def prepare():
        w = shared.value.astype(np.float64)

        def make(texts: pa.Array, _: pa.RecordBatch) -> list[pa.Array]:
            texts = texts.fill_null("")
            words = words_of(pc.utf8_lower(texts), ALPHANUMERIC)
            number, ranges = sentences_of(words)
            at = distinct(words, number)
            own = w[features(words)[:, at]]
            n = int(ranges[-1])
            telling_words = np.bincount(number[at], (own != 0).any(0), n)
            z = np.where(telling_words > 0, np.bincount(number[at], own.sum(0), n) + w[-1], -np.inf)
            p, none = noisy_or(z, ranges)
            inactive = np.concatenate([[0], np.cumsum(telling_words == 0)])
            none = none - background(np.diff(inactive[ranges])) * np.logaddexp(0, w[-1])
            total = np.clip(-np.expm1(none), 0, 1)
            bad = np.flatnonzero(p >= locate)
            bounds = np.searchsorted(bad, ranges)
            return [
                pa.array(total),
                pa.array((total >= 0.5).astype(np.int32)),
                lists(np.array(located(texts, words, number, bad, ranges), object), bounds, pa.string()),
                lists(p[bad], bounds),
            ]

        return make

    return map_texts(docs, text, keep, ddl, prepare)


def located(texts: pa.Array, words: Words, number: np.ndarray, bad: np.ndarray, ranges: np.ndarray) -> list[str]:
    """The sentences numbered `bad`, as they stand in the texts."""
    if not len(bad):
        return []
    marks = np.concatenate([[0], np.cumsum(SENTENCE_ENDS[words.data])])
    rows = np.searchsorted(ranges, bad, "right") - 1
    first = np.searchsorted(number, bad)
    order = marks[words.starts[first]] - marks[words.offsets[rows]]  # which part of its text: lower case moves no sentence end
    out, split = [], {}
    for r, k in zip(rows.tolist(), order.tolist(), strict=True):
        if r not in split:
            split = {r: texts[r].as_py().translate(_ENDS).split("\n")}
        out.append(split[r][k].strip())
    return out


_ENDS = {ord(c): "\n" for c in ".!?"}


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", mod: int = 5, max_rows: int = 4000, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    return score(docs, train(docs, labels, text, id_col, label, mod, max_rows), text, keep, prefix=prefix)


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those predicted toxic."""
    return toxicity(docs, labels, text, prefix="__tox_", **options).where("__tox_predicted = 0").select(*docs.columns)
