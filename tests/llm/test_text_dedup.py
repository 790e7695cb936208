import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tenderlens.llm import jaccard, line_dedup, substring_dedup
from tests.llm.common import SCHEMA, clashing, odd_documents, prose, words


def documents(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


def removed_by_windows(rows, k=13):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for a in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        hit = [False] * len(w)
        for a in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[a : a + k])] < i:
                hit[a : a + k] = [True] * k
        kept = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out.append((i, len(w), sum(hit), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    rows = odd_documents()
    rows += [(
        300 + i,
        prose(300 + i, 10) + " " + prose(8, 60 + i) + " " + prose(400 + i, 12),
        "en",
        "a",
        1,
    ) for i in range(12)]  # a shared passage of growing length
    rows += [(400, " ".join(["again"] * 40), "en", "a", 1), (401, " ".join(["again"] * 17), "en", "a", 1)]  # one window, many times
    out = substring_dedup.substring_dedup(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == removed_by_windows(rows)
    texts = {r[0]: words(r[1]) for r in rows if r[0] not in (12, None)}
    assert any(r.repeats for r in out) and all(
        texts[r.doc_id][x.at : x.at + x.n_words] == texts[x.source][x.source_at : x.source_at + x.n_words] for r in out if r.doc_id in texts for x in r.repeats
    )
    assert all(r.kept_text is None or hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_compaction_makes_one_span_of_a_passage(spark, monkeypatch):
    """A passage of 300 words that three documents share is one span with its source; without compaction it falls into its paths."""
    passage = prose(70, 300)
    rows = [(i, f"{prose(700 + i, 20 + i)} {passage} {prose(800 + i, 15)}", "en", "a", 1) for i in range(3)]
    expected = removed_by_windows(rows)

    def found():
        out = substring_dedup.substring_dedup(documents(spark, rows)).collect()
        return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), {r.doc_id: [tuple(x) for x in r.repeats] for r in out}

    result, repeats = found()
    assert result == expected and repeats[0] == [] and len(repeats[1]) == len(repeats[2]) == 1
    for doc in (1, 2):  # paths that run beyond the passage's ends differ, so their windows are found one by one
        (at, n, source, source_at), = repeats[doc]
        assert source == 0 and at - source_at == doc and 280 <= n <= 300
    plain = substring_dedup.compact
    alone = lambda distinct: distinct.select("number", F.col("number").alias("head"), F.lit(0).alias("ahead"))
    monkeypatch.setattr(substring_dedup, "compact", alone)
    result, repeats = found()
    assert result == expected and len(repeats[1]) > 10
    # chains decide the removals: shorter ones remove less, and longer ones differ from the words of their source
    for shift in (-60, 400):
        monkeypatch.setattr(substring_dedup, "compact", lambda distinct, shift=shift: plain(distinct).withColumn("ahead", F.when(F.col("head") == F.col("number"), 0).otherwise(F.col("ahead") + shift)))
        assert found()[0] != expected


def test_pointers_lead_to_the_first_path_of_a_chain(spark):
    """Chains of 1 to 37 paths; a path that differing paths follow or precede ends or begins one."""
    rows, expected, number = [], {}, 0
    for length in (1, 2, 3, 8, 9, 37):
        for i in range(length):
            number += 1
            rows.append((number, number, number - 1 if i else None, number + 1 if i + 1 < length else 0, i % 3 + 1, 1, 2))
            expected[number] = (number - i, sum(j % 3 + 1 for j in range(i)))
    rows += [(900, 900, 0, 901, 5, 1, 2), (901, 901, None, 0, 5, 1, 2), (902, 902, 0, 903, 5, 1, 1), (903, 903, 902, 0, 5, 1, 2)]
    expected |= {900: (900, 0), 901: (901, 0), 903: (903, 0)}  # 902 is no repeated path
    distinct = spark.createDataFrame(rows, "number long, path long, before long, after long, n int, low long, high long")
    assert {r.number: (r.head, r.ahead) for r in substring_dedup.compact(distinct).collect()} == expected


def test_spans_that_differ_from_their_source_stay(spark, monkeypatch):
    """With path hashes of no use, whatever is removed still has the words of its source."""
    monkeypatch.setattr(substring_dedup, "batched", lambda values, starts, ends: (ends - starts).astype("int64") % 2 + 1)
    rows = [(i, f"{prose(740 + i // 2, 60)} {prose(760 + i, 10 + i)}", "en", "a", 1) for i in range(6)]
    texts = {r[0]: words(r[1]) for r in rows}
    true = {r[0]: r[2] for r in removed_by_windows(rows)}
    for r in substring_dedup.substring_dedup(documents(spark, rows)).collect():
        assert r.n_removed <= true[r.doc_id]
        assert all(texts[r.doc_id][x.at : x.at + x.n_words] == texts[x.source][x.source_at : x.source_at + x.n_words] for x in r.repeats)


def test_chains_end_where_paths_branch(spark):
    """Two continuations of one passage are chains of their own."""
    a, b, c = prose(71, 80), prose(72, 80), prose(73, 80)
    texts = [f"{a} {b}", f"{a} {c}", f"{prose(74, 30)} {a} {b}", f"{prose(75, 30)} {a} {c}"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(spark, rows)).collect()}
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.values()) == removed_by_windows(rows)
    assert {x.source for x in out[1].repeats} == {0} and len(out[1].repeats) <= 2  # the path at the start of texts 0 and 1 is no others'
    assert {x.source for x in out[3].repeats} == {0, 1} and out[3].n_spans == 1


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sliding_minimum():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    assert substring_dedup.sliding_min(x, 7).tolist() == [int(x[i : i + 7].min()) for i in range(44)]


def links_by_sets(rows, n=5, threshold=0.8):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    near = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                near[i].add(j)
                near[j].add(i)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        label[i] = min(ids) if ids else None
    return Counter((r[0], c, len(near[i])) for i, (r, c) in enumerate(zip(rows, label, strict=True)))


def near_group(n, seed, size=80):
    """n texts that differ from one text in one word each."""
    base = prose(seed, size).split()
    return [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in range(n)]


def test_jaccard_links_equal_brute_force(spark):
    rows = odd_documents() + [(500 + i, t, "en", "a", 1) for i, t in enumerate(near_group(30, 9))]
    out = jaccard.jaccard_join(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == links_by_sets(rows)


def test_jaccard_tiles_count_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(near_group(40, 10, 200))]
    out = jaccard.jaccard_join(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == links_by_sets(rows)


def test_jaccard_tiles_of_a_chain_of_growing_texts(spark, monkeypatch):
    """Prefixes of one text, each near its neighbours in size only: tiles of like size meet, no link is lost, the longest never meet the shortest."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
    base, made = prose(11, 600).split(), []
    whole = jaccard.tiles
    monkeypatch.setattr(jaccard, "tiles", lambda *a: made.append(whole(*a)) or made[-1])
    rows = [(i, " ".join(base[: int(30 * 1.06**i)]), "en", "a", 1) for i in range(50)]
    out = jaccard.jaccard_join(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == links_by_sets(rows)
    steps = {int(high) - int(low) for low, high in (r.block.split(":")[1:4:2] for r in made[0].collect())}
    assert steps == {0, 1}


def test_keep_one_of_each_class(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    classes = {c for _, c, _ in links_by_sets(rows)}
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) == classes and got[12] == 2 and all(n == 1 for i, n in got.items() if i not in (12, None))


def test_keep_one_of_classes_with_null_and_repeated_ids(spark):
    """One row of each class, also where ids are null or stand for several texts."""
    base, null_only = near_group(3, 30), near_group(4, 31)
    rows = [
        (1, base[0]),
        (None, base[1]),
        (None, base[2]),
        *((None, t) for t in null_only),
        (None, null_only[0]),
        (7, prose(32, 60)),
        (7, base[0]),
        (8, prose(33, 60)),
        (8, prose(32, 60)),
        (None, prose(34, 60)),
    ]
    rows = [(i, t, "en", "a", 1) for i, t in rows]
    out = jaccard.keep_one(documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter([1, None, 7, 8, None])
    assert {r.text for r in out if r.doc_id} == {base[0], prose(32, 60), prose(33, 60)}
    assert sorted(r.text in null_only for r in out if r.doc_id is None) == [False, True]


def test_texts_of_rows_without_an_id_are_fetched_once(spark, monkeypatch):
    """A third of the ids is null: each class fetches one row's text, not those of all rows without an id."""
    groups = [near_group(3, 900 + g, 40) for g in range(30)]
    rows = [(None if (g + i) % 3 == 0 else 10 * g + i, t, "en", "a", 1) for g, texts in enumerate(groups) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "en", "a", 1) for texts in groups[:10]]
    fetched, emit = [], jaccard.emit_rows

    def counted(df, *rest):
        fetched.append(df.count())
        return emit(df, *rest)

    monkeypatch.setattr(jaccard, "emit_rows", counted)
    out = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == links_by_sets(rows)
    assert sum(fetched) <= 2 * len(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("threshold", "recall"), [(0.8, 0.999), (0.5, 0.9), (0.95, 0.99)])
def test_band_plan_reaches_its_recall(threshold, recall):
    bands, rows = jaccard.band_plan(threshold, recall)
    assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 96


def test_patience_alignment():
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.patience([1, 2, 1, 3], [1, 2, 1, 3]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert line_dedup.patience([], [1]) == []
    assert line_dedup.longest_rising([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def lines_left(rows):
    hashed = [(r[0], [line_dedup.line_hash(x) for x in line_dedup.lines_of(r[1])], line_dedup.lines_of(r[1])) for r in rows]
    texts = {}
    for i, h, _ in hashed:
        if i is not None:
            texts[tuple(h)] = min(texts.get(tuple(h), i), i)
    first = {}
    for h, i in texts.items():
        for x in h:
            if x:
                first[x] = min(first.get(x, i), i)
    of = defaultdict(list)
    for h, i in texts.items():
        of[i].append(list(h))
    out = []
    for i, h, raw in hashed:
        owner = texts.get(tuple(h))
        if h and owner is not None and (i is None or owner < i):
            gone = set(range(len(h)))
        elif i is None:
            gone = set()
        else:
            gone = {j for o in {first[x] for x in h if x} if o < i for early in of[o] for j in line_dedup.aligned_blocks(early, h, 1)}
        kept = "\n".join(x for j, x in enumerate(raw) if j not in gone)
        out.append((i, len(h), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_line_dedup_equals_brute_force(spark):
    lines = [prose(600 + i, 6) for i in range(30)]
    rows = odd_documents() + [(700 + i, "\n".join(lines[i : i + 9] + [f"own {i}", ""] + lines[2 * i : 2 * i + 3]), "en", "a", 1) for i in range(12)]
    rows += [(800 + i, lines[0], "en", "a", 1) for i in range(5)]
    out = line_dedup.line_dedup(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in out) == lines_left(rows)


def lines_gone_by_all_pairs(rows):
    """Per id, positions of lines (not of empty ones) that align with any earlier text."""
    hashed = [(i, [line_dedup.line_hash(x) for x in line_dedup.lines_of(t)]) for i, t, *_ in rows]
    return {i: {j for k, early in hashed if k < i for j in line_dedup.aligned_blocks(early, late, 1) if late[j]} for i, late in hashed}


def test_line_dedup_aligns_with_every_earlier_holder(spark):
    """Lines that cross in the pair with their first holder, or that it repeats, align with a later holder."""
    a, b, c, d = (prose(620 + i, 6) for i in range(4))
    rows = [(i, "\n".join(x), "en", "a", 1) for i, x in enumerate([
        [a, "p", b],
        [b, "q", a],
        [c, "r", c],
        [b, "s", a, "t", c],
        [d, "", c, "", d],
        ["u", c, "v", c, "w"],
        ["x", d, "", c],
        [a, b],
        ["y", b, a, "z"],
    ])]
    pool = [prose(640 + i, 4) for i in range(8)]
    rng = random.Random(4)
    rows += [(20 + i, "\n".join([rng.choice([*pool, f"own {i} {j}", ""]) for j in range(9)] + [f"own {i}"]), "en", "a", 1) for i in range(40)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(documents(spark, rows)).collect()}
    want = lines_gone_by_all_pairs(rows)
    for i, text, *_ in rows:
        kept = [x for j, x in enumerate(text.split("\n")) if x and j not in want[i]]
        left = text if out[i].kept_text is None else out[i].kept_text
        assert [x for x in left.split("\n") if x] == kept


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
