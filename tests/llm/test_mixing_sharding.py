import zlib
from collections import Counter
from fractions import Fraction

import pytest
from tenderlens.llm import mixing, sharding
from tests.llm.common import SCHEMA, clashing, odd_documents, prose, words


def water_level(sizes):
    """Targets by plain iteration: whoever exceeds three times its size is fixed there, the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_follow_weights_and_caps(spark):
    rows = odd_documents()
    plan = mixing.mixing_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = water_level(sizes)
    assert len(plan) == len(rows)
    for r in plan:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.size == len(words(r.text))
        assert r.copies in (int(r.target / r.source_size + 1e-9), int(r.target / r.source_size + 1e-9) + 1) and r.copies <= 3


def test_mix_repeats_rows_and_keeps_clashing_columns(spark):
    docs = clashing(spark.createDataFrame(odd_documents(), SCHEMA))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.where("size <> 'kept'").count() == 0
    want = Counter()
    for r in mixing.mixing_plan(docs).select("doc_id", "text", "copies").collect():
        want[(r.doc_id, r.text)] += r.copies
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want
    assert Counter(map(str, out.collect())) == Counter(map(str, mixing.mix(docs).collect()))


def test_mixing_without_words_or_rows(spark):
    plan = mixing.mixing_plan(spark.createDataFrame([(1, None, "en", "a", 1), (2, " ", "en", None, 1)], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in plan] == [(0, 0.0, 0)] * 2
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shards_are_even_gapless_and_mixed(spark):
    rows = odd_documents()
    out = sharding.assign_shards(clashing(spark.createDataFrame(rows, SCHEMA)), shards=5, least_bucket=4).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(5))
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    mixture = Counter((r.source, r.shard) for r in out)
    for source in {r.source for r in out}:
        per = [mixture[source, s] for s in range(5)]
        assert max(per) - min(per) <= 2
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 16 for r in out)


def test_shard_order_is_that_of_fractional_ranks(spark):
    rows = [(i, "t", "en", "ab"[i % 7 == 0], 1) for i in range(300)]
    out = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), shards=4, least_bucket=10).collect()
    again = sharding.assign_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), shards=4, least_bucket=50).collect()
    place = lambda t: {r.doc_id: (r.shard, r.slot) for r in t}
    assert place(out) == place(again)
    for source, n in (("a", 257), ("b", 43)):
        assert all(abs(sum(r.source == source and r.shard == s for r in out) - n / 4) < 1.01 for s in range(4))


def placed_by_force(rows, hashes, shards):
    """(row number) -> (shard, slot): ranks by plain sorting, one global order of exact fractions, one cut."""
    key = lambda i: (
        hashes[i],
        rows[i][0] is not None,
        rows[i][0] or 0,
        zlib.crc32((rows[i][1] or "").encode()),
        len((rows[i][1] or "").encode()),
    )
    by_source = {}
    for i in sorted(range(len(rows)), key=key):
        by_source.setdefault(rows[i][3], []).append(i)
    fraction = {i: Fraction(2 * r + 1, 2 * len(own)) for own in by_source.values() for r, i in enumerate(own)}
    order = sorted(range(len(rows)), key=lambda i: (float(fraction[i]), rows[i][3] is not None, rows[i][3] or "", key(i)))
    starts = [s * len(rows) // shards for s in range(shards + 1)]
    out = {}
    for position, i in enumerate(order):
        shard = next(s for s in range(shards) if starts[s] <= position < starts[s + 1])
        out[i] = (shard, position - starts[shard])
    return out


@pytest.mark.parametrize(("shards", "least_bucket"), [(5, 4), (40, 1024), (7, 1)])
def test_sharding_equals_brute_force(spark, shards, least_bucket):
    rows = [r for r in odd_documents() if r[0] != 12 or r[1] != odd_documents()[11][1]]  # equal rows may change places
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", n int")
    hashes = {r.n: r.h for r in frame.selectExpr("n", "xxhash64(42, cast(doc_id as string)) as h").collect()}
    out = sharding.assign_shards(frame.repartition(3), shards=shards, least_bucket=least_bucket).collect()
    assert {r.n: (r.shard, r.slot) for r in out} == placed_by_force(rows, hashes, shards)


def test_rows_without_an_id_fall_into_many_buckets(spark, monkeypatch):
    """A third of the rows has no id; no bucket holds more than a few of them, and the order is that of plain sorting."""
    rows = [(None if i % 3 else i, prose(i, 5), "en", "a", 1) for i in range(400)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", n int")
    hashes = {r.n: r.h for r in frame.selectExpr("n", "xxhash64(42, cast(doc_id as string)) as h").collect()}
    seen, numbered = [], sharding._numbered

    def watched(rows, group, order, first):
        seen.append(max(r["count"] for r in rows.groupBy(*group, "__shard_bucket").count().collect()))
        return numbered(rows, group, order, first)

    monkeypatch.setattr(sharding, "_numbered", watched)
    out = sharding.assign_shards(frame, shards=7, least_bucket=10).collect()
    assert {r.n: (r.shard, r.slot) for r in out} == placed_by_force(rows, hashes, 7)
    assert max(seen) <= 50


def test_sharding_an_empty_table(spark):
    assert sharding.assign_shards(spark.createDataFrame([], SCHEMA)).collect() == []
