"""Spelling variants, periodic runs and suffix arrays against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tenderlens.llm import periodic_runs, queries, spelling_variants, suffix_dedup, tokens
from tests.llm.common import SCHEMA, clashing, odd_documents, prose, words

# --- spelling variants


def counted(rows, plant=True):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if plant and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def deletions(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return (a in deletions(b)) if len(a) + 1 == len(b) else (b in deletions(a)) if len(b) + 1 == len(a) else False


def variants(total):
    share = defaultdict(set)
    for w in total:
        for d in deletions(w) | {w}:
            share[d].add(w)
    near = defaultdict(set)
    for group in share.values():
        for a in group:
            near[a] |= {b for b in group if a != b and is_near(a, b)}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-total[o], o))
            if total[best] >= 5 * total[w]:
                form[w] = best
    out = set()
    for w, n in total.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), total.get(form.get(w))))
    return out


def misspelt(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 9))) for _ in range(20)] + ["abababab", "ééééééé", "z" * 70, "z" * 71, "z" * 69 + "y"]
    out = []
    for _ in range(n):
        w = list(r.choice(stems))
        for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice(([], [r.choice("abÀ")], [w[at], r.choice("abÿ")]))
        out.append("".join(w))
    return " ".join(out)


@pytest.mark.parametrize("cell_words", [None, 8])
def test_variants_equal_brute_force(spark, tmp_path, cell_words, monkeypatch):
    rows = odd_documents() + [(1000 + i, misspelt(i, 400).replace("ab", "AB", i), "en", "a", 1) for i in range(30)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    if cell_words:
        counts = spelling_variants.word_counts(docs, id_col="doc_id")
        found = spelling_variants.spelling_variants(counts, cell_words=cell_words)
    else:
        found = queries.op11_spelling_variants(spark, str(tmp_path))
    want = variants(counted(rows))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert max(n for *_, n, _ in want) > 5 and any(w != r and f != r for w, f, r, *_ in want if f)  # chains of forms too


def test_variants_without_planted_deletions_and_without_words(spark):
    rows = [(1, misspelt(5, 3000), "en", "a", 1)]
    counts = spelling_variants.word_counts(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in spelling_variants.spelling_variants(counts, cell_words=4).collect()} == variants(counted(rows, plant=False))
    empty = spark.createDataFrame([(1, None, None, None, None), (2, "12 34", None, None, None)], SCHEMA)
    assert spelling_variants.spelling_variants(spelling_variants.word_counts(empty)).collect() == []


def test_trees_find_all_within_reach():
    r = np.random.default_rng(3)
    words_ = sorted({"".join(r.choice(list("abcdefé"), 7)) for _ in range(1500)})
    points = spelling_variants.vectors(words_)
    pairs = {(int(q), int(p)) for a, b in spelling_variants.Tree(points).within(points, np.full(len(points), 2)) for q, p in zip(a, b, strict=True)}
    off = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2)
    assert pairs == set(map(tuple, np.argwhere(off <= 2).tolist()))


# --- periodic runs


def all_runs(w):
    spans = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i:
                spans.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in spans.items() if e - s >= max(6, 4 * q)), key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]


def run_row(doc_id, text):
    w = planted(doc_id, words(text))
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def repeating(seed, n):
    r = random.Random(seed)
    w = [str(r.randrange(r.choice((1, 2, 3, 40)))) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        a, p = r.randrange(n), r.randint(1, 1 + n // 5)
        w[a : a + 5 * p] = [w[a + (i % p)] if a + (i % p) < n else "x" for i in range(5 * p)]
    return "\t ".join(w)


def test_periodic_runs_equal_brute_force(spark, tmp_path):
    rows = odd_documents() + [(2000 + i, repeating(i, 10 + 3 * i), "en", "a", 1) for i in range(120)]
    rows += [(3000, " ".join(["again"] * 3000), "en", "a", 1), (3001, " ".join(f"w{i % 700}" for i in range(3000)), "en", "a", 1), (3002, prose(9, 900) + " " + " ".join(["a b c"] * 400), "en", "a", 1)]
    clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_periodic_runs(spark, str(tmp_path)).drop("n_words").collect()
    assert Counter(tuple(r) for r in out) == Counter(run_row(*r[:2]) for r in rows)
    assert sum(r.n_runs > 1 for r in out) > 10


def test_blocks_longer_than_a_transform_and_deceiving_hashes(monkeypatch):
    monkeypatch.setattr(periodic_runs, "MAX_BLOCK", 4)
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(0, 150)
        w = [r.randrange(r.choice((2, 60))) for _ in range(n)]
        if n:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(4, 6)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert [x[1:] for x in periodic_runs.find_runs(np.array(w, np.uint64), np.array([0, n]))] == all_runs(w)
    text = "a b c d e f g h"
    found = tokens.words_of(pa.array([text]))
    found.hashes[:] = 7  # all words seem equal
    assert periodic_runs.runs_of(found, [text])[0] == [[]]


def test_transforms_are_exact():
    r = np.random.default_rng(5)
    for b in (1, 2, 8, 64, 8192):
        blocks, windows = r.integers(0, 256, (b, 3)).astype(np.uint8), r.integers(0, 256, (2 * b, 3)).astype(np.uint8)
        got = periodic_runs.squared_differences(blocks, windows)
        for s in {0, b // 2, b - 1}:
            assert (got[s] == ((blocks.astype(np.int64) - windows[s : s + b].astype(np.int64)) ** 2).sum(axis=0)).all()


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


# --- suffix arrays


def byte_removals(rows, width=100):
    first = {}
    for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        t = (text or "").encode()
        for a in range(len(t) - width + 1):
            first.setdefault(t[a : a + width], (doc_id, a))
    out = []
    for doc_id, text, *_ in rows:
        t = (text or "").encode()
        own = {}
        gone = bytearray(len(t))
        for a in range(len(t) - width + 1):
            s = t[a : a + width]
            if own.setdefault(s, a) < a or doc_id is not None and first[s] < (doc_id, a):
                gone[a : a + width] = b"\1" * width
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def quoting():
    """A passage in many texts between words of their own, one that overlaps itself, and a copy that ends within a letter of two bytes."""
    passage = prose(50, 60)
    rows = [(500 + i, f"{prose(500 + i, 12)} {passage} {prose(600 + i, 12)}", "en", "a", 1) for i in range(40)]
    rows += [(700 + i, "ab" * (60 + 7 * i) + "c" * i, "en", "a", 1) for i in range(5)]
    return rows + [(800, "é" * 80, "en", "a", 1), (801, "x" + "é" * 70, "en", "a", 1), (802, passage[:99], "en", "a", 1), (803, passage[:100], "en", "a", 1), (None, passage + passage, "en", "a", 1)]


@pytest.mark.parametrize("hot", [256, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rows = odd_documents() + quoting()
    out = suffix_dedup.suffix_dedup(clashing(spark.createDataFrame(rows, SCHEMA)), hot=hot).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)
    assert got == byte_removals(rows)
    assert all(sum(s.n for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in out)


def test_crowded_anchors_go_on_in_parts_not_windows(spark):
    """Strings around one passage with ends of their own: few rows a string, and after the first cut only what may still repeat."""
    passage = prose(50, 60)
    texts = spark.createDataFrame([(i, i, f"{prose(500 + i, 12)} {passage} {prose(600 + i, 12)}") for i in range(40)], "doc long, key long, body string")
    grams = spark.createDataFrame([(i, [int(h) for h in np.unique(suffix_dedup.anchored(*tokens.text_buffer(pa.array([r.body])), 100, 32)[2]).view(np.int64)]) for i, r in enumerate(texts.collect())], "doc long, grams array<long>")
    found = suffix_dedup.occurrences(texts.join(grams, "doc"), 100, 32)
    strings = found.select("gram", F.lit(0).cast("long").alias("scope"), "body", "doc", "key", "at", F.unhex(F.md5("body")).alias("number"))
    strings = suffix_dedup.written(suffix_dedup.merged(strings))
    crowded = strings.join(suffix_dedup.crowded_in(strings, 2), "gram")
    windows = crowded.agg(F.sum(F.octet_length("body") - 99)).first()[0]
    rows, one = suffix_dedup.halved(crowded, 100, 32, 16)
    assert 0 < rows.count() < suffix_dedup.parts_of(crowded, 100, 32, 16).count() < windows / 6
    assert one.count() == rows.select("number").distinct().count()
    bits = spark.range(1, 65).select("id", suffix_dedup.lowest_bits(F.col("id")).alias("m")).collect()
    assert all(r.m % 2**64 == 2**r.id - 1 for r in bits)


def test_suffix_dedup_without_anchors_and_in_stretches(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(empty).collect() == []
    data = np.frombuffer(("ab" * 70 + prose(1, 300)).encode(), np.uint8)
    whole = suffix_dedup.anchored(data, np.array([0, len(data)]), 100, 32)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 500)
    parts = [(at + first, anchor) for first, own, bounds in suffix_dedup._stretches(data, np.array([0, len(data)]), 100) for at, _, anchor, _ in [suffix_dedup.anchored(own, bounds, 100, 32)]]
    assert (np.concatenate([p[0] for p in parts]) == whole[0]).all() and (np.concatenate([p[1] for p in parts]) == whole[2]).all()


def test_two_stage_arrays_are_sorted_with_their_prefixes():
    r = random.Random(3)
    for _ in range(100):
        k = r.choice((1, 2, 3, 20))
        text = b"".join(bytes(r.randrange(97, 97 + k) for _ in range(r.randint(1, 60))) + b"\xff" for _ in range(r.randint(1, 6)))
        data = np.frombuffer(text, np.uint8)
        array = suffix_dedup.suffix_array(data, 16)
        keys = [(text[i:] + bytes(16))[:16] for i in array]
        assert sorted(array.tolist()) == list(range(len(text))) and keys == sorted(keys)
        prefix = suffix_dedup.common_prefix(data, array, 16)
        assert all(prefix[i] == next((j for j in range(16) if keys[i][j] != keys[i - 1][j]), 16) for i in range(1, len(keys)))


def test_arrays_decide_what_repeats(monkeypatch):
    """Without common prefixes nothing repeats."""
    text = prose(1, 30).encode()
    table = pa.table({
        "number": [b"1", b"2"], "scope": pa.array([0, 0]), "body": [(b"xxx" + text)[:120], text[:120]], "doc": pa.array([5, 3]), "key": pa.array([1, 1]), "at": pa.array([7, 0]), "repeated": [False, False]
    })
    inner = suffix_dedup.judge(table, 100)["inner"].to_pylist()
    assert inner == [sum(1 << i for i in range(3, 21)), 0]
    monkeypatch.setattr(suffix_dedup, "common_prefix", lambda data, array, depth: np.zeros(len(array), np.int64))
    assert suffix_dedup.judge(table, 100)["inner"].to_pylist() == [0, 0]


def test_planted_query_leaves_texts_alone_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert {tuple(r) for r in queries.planted(docs).select("doc_id", F.coalesce("text", F.lit("-"))).collect()} == {(None, "a b"), (1, "-")}
