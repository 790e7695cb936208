import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tenderlens.llm import lm, toxicity
from tests.llm.common import ALNUM, SCHEMA, clashing, fold, odd_documents, prose, words


def test_lm_base_and_counts_equal_brute_force(spark, monkeypatch):
    rows = odd_documents()
    out = lm.lm_scores(clashing(spark.createDataFrame(rows, SCHEMA)), head=50).collect()
    tokens = [[*words(fold(r[1])), None] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    c = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    want = Counter((
        r[0],
        h,
        len(t),
        sum(c[x] > 0 for x in t),
        n,
        round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6),
    ) for r, t, h in zip(rows, tokens, held, strict=True))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_lm_learns_what_follows_what(spark):
    """Two kinds of text with words of their own: history tells which, which word frequency alone cannot."""
    kinds = [("ana bela cora dita", "enzo fabo gigo hulo")[i % 2].split() for i in range(400)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(k, 40)), "en", "a", 1) for i, k in enumerate(kinds)]
    out = [r for r in lm.lm_scores(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    assert out and all(r.score > r.base_score + 2 for r in out)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Nine training tasks, whether the rows come in one partition, in eight, or the other way round."""
    monkeypatch.setattr(lm, "TEXT_PER_WEIGHT", 0.005)
    rows = [*odd_documents(), *((1000 + i, prose(1000 + i, 60), "en", "a", 1) for i in range(200))]
    found = []
    for n, order in ((1, rows), (8, rows), (3, rows[::-1])):
        docs = spark.createDataFrame(order, SCHEMA).repartition(n)
        found.append(sorted((r.doc_id or 0, r.n_tokens, round(r.base_score, 6), round(r.score, 4)) for r in lm.lm_scores(docs).collect()))
    assert found[0] == found[1] == found[2]
    assert any(abs(score - base) > 0.5 for _, _, base, score in found[0])


def mixed(x):
    """The 64-bit finaliser, in plain integers."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


def plain_model(texts, counts, rows):
    """Weight rows and class of each token, by plain Python over words: ranks by count and hash, suffix of two bytes."""
    rank = {h: i for i, (h, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    units, out = rows // lm.ROWS_PER_UNIT, []
    for text in texts:
        parts = [w for w in words(fold(text))]
        hashes = [int(h) for h in lm.words_of(pa.array([" ".join(parts)]), lm.SPACE_SEPARATED, fold=True).hashes] + [int(lm.END)]
        ends = [int(lm.words_of(
            pa.array([w.encode()[-2:].decode("latin1")]),
            lm.SPACE_SEPARATED,
        ).hashes[0]) % lm.SUFFIX_CLASSES for w in parts] + [lm.END_CLASS]
        unit = [rank[h] if rank.get(h, units) < units else units + e for h, e in zip(hashes, ends)]
        for i, (h, e) in enumerate(zip(hashes, ends)):
            one, two, three = (unit[i - k] if i >= k else units + lm.SUFFIX_CLASSES for k in (1, 2, 3))
            wide = 1 << 20
            keys = (one, two + wide, three + 2 * wide, one * wide + two + wide * wide)
            out.append(([mixed(k) % rows for k in keys], rank[h] if rank.get(h, lm.SINGLES) < lm.SINGLES else lm.SINGLES + e))
    return out


def test_lm_class_probabilities_equal_a_plain_model_with_given_weights():
    texts = ["the cat sat on the mat the cat ran", "dogs ran to the cat", "", "A a b " * 700]
    t = lm.Tokens(pa.array(texts))
    h, c = np.unique(t.hashes, return_counts=True)
    vocabulary = lm.Vocabulary(h[:9], c[:9], 1 << 13)
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=(1 << 13, lm.CLASSES)).astype(np.float32), rng.normal(size=lm.CLASSES).astype(np.float32)
    rank = vocabulary.find(t.hashes)
    features, classes = vocabulary.features(t, rank), vocabulary.classes(t, rank)
    plain = plain_model(texts, dict(zip(h[:9].tolist(), c[:9].tolist())), 1 << 13)
    assert features.T.tolist() == [f for f, _ in plain] and classes.tolist() == [k for _, k in plain]
    got = lm.log_probabilities(weights, bias, features, classes)
    for own, (f, k) in zip(got, plain, strict=True):
        z = [float(bias[j]) + sum(float(weights[r, j]) for r in f) for j in range(lm.CLASSES)]
        assert own == pytest.approx(z[k] - math.log(sum(math.exp(x) for x in z)), abs=1e-4)
    every = sum(np.exp(lm.log_probabilities(weights, bias, features, np.full(len(classes), k))) for k in range(lm.CLASSES))
    assert every == pytest.approx(1, abs=1e-4)


def test_lm_gradient_step_equals_a_plain_sum():
    rng = np.random.default_rng(5)
    n = 3000
    rows, classes = (rng.pareto(0.8, (lm.KINDS, n)) * 3).astype(np.int64) % 64, rng.integers(0, lm.CLASSES, n)
    bias, scale = np.zeros(lm.CLASSES, np.float32), np.full(lm.CLASSES, 0.02, np.float32)
    weights, seen = np.zeros((64, lm.CLASSES), np.float32), np.zeros(64, np.float32)
    slope = lm.slopes(weights, bias, rows, classes)[:-1].astype(np.float64)
    assert slope.sum(1) == pytest.approx(0, abs=1e-5)
    for kind in range(lm.KINDS):  # the kinds' updates follow one another, all from the same slopes
        grad = np.zeros((64, lm.CLASSES))
        np.add.at(grad, rows[kind], slope)
        order = np.argsort(rows[kind])
        _, sizes = np.unique(rows[kind], return_counts=True)
        sums = lm.sums_of(np.vstack([slope, np.zeros(lm.CLASSES)]), order, sizes)
        assert np.allclose(sums, grad[np.unique(rows[kind])], atol=1e-9)
    lm.learn(weights, bias, seen, rows, classes, scale)
    assert seen.sum() == lm.KINDS * n and np.abs(weights).max() > 0


def test_lm_hash_index_and_row_hashes():
    rng = np.random.default_rng(2)
    known = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) | np.uint64(3 << 62)  # leading bits collide
    known = np.unique(known)
    index = lm.HashIndex(known)
    assert index.find(known).tolist() == list(range(len(known)))
    assert (index.find(rng.integers(0, 1 << 61, 5000, dtype=np.uint64)) == -1).all()
    assert lm.HashIndex(known[:0]).find(known[:3]).tolist() == [-1, -1, -1]
    values, bounds = rng.integers(0, 9, 500, dtype=np.uint64), np.array([0, 0, 3, 200, 203, 500])
    tail = np.concatenate([values[200:203], values])
    for stretch in (50, 1 << 17):  # the same rows hash alike wherever they stand
        assert lm.row_hashes(values, bounds, stretch)[3] == lm.row_hashes(tail, np.array([0, 3, 503]), stretch)[0]
        assert len(set(lm.row_hashes(values, bounds, stretch).tolist())) == 5


def test_lm_frequent_words_with_ties(spark):
    """A level that does not fit whole is taken in part: ties leave neither an empty vocabulary nor one above `head`."""
    counts = spark.range(20_000).selectExpr("id * 7919 as word", "cast(1 as byte) as suffix", "cast(if(id < 10, 1000, 3) as long) as n")
    _, _, c = lm.frequent(counts, 5000)
    assert 4900 <= len(c) <= 5000 and (c == 1000).sum() == 10
    assert len(lm.frequent(counts, 20_000)[0]) == 20_000
    assert 2 <= len(lm.frequent(counts.where("n = 1000"), 8)[0]) <= 8


def test_lm_inside_a_class_probabilities_sum_to_one():
    # inside a class: all its known words and the mass for unknown ones
    counts = np.array([3.0, 1.0, 7.0])
    inside = (counts + lm.SMOOTH) / (counts.sum() + lm.SMOOTH * (len(counts) + 1))
    assert inside.sum() + lm.SMOOTH / (counts.sum() + lm.SMOOTH * (len(counts) + 1)) == pytest.approx(1)


def test_lm_of_nothing(spark):
    assert lm.lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def labelled(n=600):
    rows, labels = [], []
    for i in range(n):
        text = [prose(i * 7 + j, 8) for j in range(5)]
        toxic = i % 4 == 0
        if toxic:
            text[i % 5] = f"you utter {('moron', 'trash', 'clown')[i % 3]} {text[i % 5]}"
        rows.append((i, ". ".join(text), "en", "a", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_from_document_labels_and_finds_the_sentence(spark):
    rows, labels = labelled()
    odd = [(1000 + i, *r[1:]) for i, r in enumerate(odd_documents())]
    docs = clashing(spark.createDataFrame(rows + odd, SCHEMA))
    out = {r.doc_id: r for r in toxicity.toxicity(
        docs,
        spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"),
        keep=["doc_id", "text"],
    ).collect()}
    assert len(out) == len(rows) + len(odd)
    test = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == t for i, t in test) >= 0.97 * len(test)
    hit = next(out[i] for i, t in test if t and out[i].predicted)
    assert len(hit.offending) == 1 and hit.offending[0].startswith("you utter") and hit.offending[0] in hit.text
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert all(out[1000 + i].score == 0 for i, r in enumerate(odd_documents()) if not words(r[1]))


def test_toxicity_features_do_not_depend_on_the_weight_of_sample_rows():
    """A word in four toxic sample rows and no clean one is chance, however many rows each of them stands for."""
    rows, labels = labelled(400)
    kind = np.array([t for _, t in labels])
    texts = [r[1] for r in rows]
    for i in np.flatnonzero(kind)[:4]:
        texts[i] += " fortuitous"
    plain, times_100 = (toxicity.fit(pa.array(texts), kind, np.full(len(texts), w)) for w in (1.0, 100.0))
    assert np.flatnonzero(plain).tolist() == np.flatnonzero(times_100).tolist()

    def weight(w, word):
        return w[toxicity.features(toxicity.words_of(pa.array([word]), toxicity.ALPHANUMERIC))[0, 0]]

    assert all(weight(w, "fortuitous") == 0 and weight(w, "moron") > 0 for w in (plain, times_100))


def test_toxicity_training_over_tasks_equals_plain_descent(spark):
    """Weights from distributed counts and reduced texts, against the likelihood's gradient written out row by row."""
    rows, labels = labelled(160)
    kind = dict(labels)
    docs, known = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.train(docs, known, epochs=7)
    chosen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    texts, y = pa.array([r[1] for r in chosen]), np.array([kind[r[0]] for r in chosen])
    assert np.allclose(toxicity.fit(texts, y, np.ones(len(y)), epochs=7), got, atol=1e-5)

    words, number, ranges = toxicity.parsed(texts)
    index, own = toxicity.features(words), set(np.flatnonzero(got[:-1]).tolist())
    bags = []  # per row, per sentence: the features of its distinct words
    for r in range(len(y)):
        first = {}
        for i in range(words.bounds[r], words.bounds[r + 1]):
            first.setdefault((number[i], words.hashes[i]), i)
        bags.append([[f for (s, _), i in first.items() if s == n for f in index[:, i].tolist() if f in own] for n in range(ranges[r], ranges[r + 1])])
    w, bias, seen, seen_bias = dict.fromkeys(own, 0.0), toxicity.START_BIAS, dict.fromkeys(own, 0.01), 0.01
    for _ in range(7):
        grad, grad_bias = {f: -0.1 * w[f] for f in own}, 0.0
        for bag, label in zip(bags, y, strict=True):
            n_plain = math.log1p(sum(not s for s in bag))  # the background
            bag = [s for s in bag if s]
            p = [1 / (1 + math.exp(-bias - sum(w[f] for f in s))) for s in bag]
            p_plain = 1 / (1 + math.exp(-bias))
            none = min(sum(math.log(1 - x) for x in p) + n_plain * math.log(1 - p_plain), -1e-9)
            up = math.exp(none) / (1 - math.exp(none)) if label else -1.0
            grad_bias += n_plain * p_plain * up
            for s, x in zip(bag, p, strict=True):
                grad_bias += x * up
                for f in s:
                    grad[f] += x * up
        for f in own:
            seen[f] += grad[f] ** 2
            w[f] += 0.3 * grad[f] / math.sqrt(seen[f])
        seen_bias += grad_bias**2
        bias += 0.3 * grad_bias / math.sqrt(seen_bias)
    assert got[-1] == pytest.approx(bias, abs=1e-4) and all(got[f] == pytest.approx(w[f], abs=1e-4) for f in own) and len(own) > 3


def test_toxicity_scores_equal_brute_force(spark):
    """Every document's score from its sentences by plain Python, with given weights."""
    rng = np.random.default_rng(9)
    weights = rng.normal(0, 1.5, (1 << toxicity.BITS) + 1).astype(np.float32)
    weights[-1] = -4
    docs = odd_documents()
    out = toxicity.score(spark.createDataFrame(docs, SCHEMA), weights, keep=["doc_id", "text"]).collect()
    for r in out:
        lost = 0.0
        for sentence in re.split(r"[.!?\n]", (r.text or "").lower()):
            parts = set(ALNUM.findall(sentence))
            if parts:
                one = toxicity.words_of(pa.array([" ".join(sorted(parts))]), toxicity.ALPHANUMERIC)
                z = weights[toxicity.features(one)].astype(float).sum() + float(weights[-1])
                lost += math.log1p(-1 / (1 + math.exp(-min(z, 30)))) if z < 30 else -z
        assert r.score == pytest.approx(-math.expm1(lost), abs=1e-6) and r.predicted == int(r.score >= 0.5)


def test_toxicity_of_clean_texts_does_not_grow_with_length(spark):
    rows, labels = labelled(400)
    weights = toxicity.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    clean = ". ".join(prose(50_000 + i, 8) for i in range(6000))
    docs = spark.createDataFrame([(1, clean, "en", "a", 1), (2, f"{clean}. you utter moron", "en", "a", 1)], SCHEMA)
    out = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert out[1].predicted == 0 and out[1].score < 0.1 and out[2].predicted == 1 and len(out[2].offending) == 1


def test_toxicity_filter_keeps_columns(spark):
    rows, labels = labelled(120)
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    out = toxicity.keep_clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == docs.columns and out.where("score <> 'kept'").count() == 0


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(spark.createDataFrame(odd_documents(), SCHEMA), none).collect()
    assert all(r.predicted == 0 or len(words(r.text)) > 100 for r in out)
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_toxicity_without_labels_scores_long_texts_zero(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "A clean sentence. " * 5000, "en", "a", 1)], SCHEMA)
    out = toxicity.toxicity(docs, none).collect()
    assert [(r.score, r.predicted, r.offending) for r in out] == [(0, 0, [])]
    assert toxicity.keep_clean(docs, none).count() == 1
