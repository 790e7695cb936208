import sys
from collections import Counter

import corpus_pipeline
from tenderlens.llm import cluster
from tests.llm.common import SCHEMA, clashing, odd_documents, prose, words
from tests.llm.test_mixing_sharding import water_level
from tests.llm.test_models import labelled
from tests.llm.test_search import hits_by_force
from tests.llm.test_text_dedup import links_by_sets


def tables(spark, folder):
    rows, labels = labelled(200)
    rows += [(2000 + (i if r[0] is None else r[0]), *r[1:]) for i, r in enumerate(odd_documents()) if r[0] != 12]
    item = prose(77, 30)
    rows += [(3000 + i, f"{prose(3000 + i, 40)} {' '.join(item.split()[: 13 + i])} {prose(3100 + i, 400 * (i % 2))}", "en", "a", 1) for i in range(8)]
    items = [("i1", item), ("i2", prose(78, 20))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, dict(labels), items


def test_stages_equal_brute_force(spark, tmp_path):
    folder = str(tmp_path / "sf")
    rows, labels, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.columns[:5] == corpus_pipeline.COLUMNS and (name == "sharding" or len(docs.columns) == 5)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        left[name] = docs.collect()
    by_id = {r[0]: r for r in rows}

    clean = {r.doc_id for r in left["toxicity"]}
    gone = set(by_id) - clean
    assert sum(labels.get(i, 0) for i in gone) >= 0.9 * sum(labels.values()) and sum(not labels.get(i, 0) for i in gone) <= 3

    kept = [by_id[i] for i in sorted(clean)]
    assert sorted(r.doc_id for r in left["ngram_jaccard_join"]) == sorted({c for _, c, _ in links_by_sets(kept)})

    kept = [by_id[r.doc_id] for r in left["ngram_jaccard_join"]]
    bad = {i for i, *_, contaminated in hits_by_force(kept, items) if contaminated}
    assert bad and sorted(r.doc_id for r in left["decontamination"]) == sorted({r[0] for r in kept} - bad)
    assert all(tuple(r) == by_id[r.doc_id] for r in left["decontamination"])

    sizes = Counter()
    for r in left["decontamination"]:
        sizes[r.source] += len(words(r.text))
    rate = {s: t / sizes[s] if sizes[s] else 0 for s, t in water_level(sizes).items()}
    copies = Counter(r.doc_id for r in left["mixing"])
    assert all(copies[r.doc_id] - int(rate[r.source] + 1e-9) in (0, 1) and copies[r.doc_id] <= 3 for r in left["decontamination"])

    assert Counter(r.doc_id for r in left["sharding"]) == copies
    shards = Counter(r.shard for r in left["sharding"])
    assert max(shards.values()) - min([*shards.values(), 0] if len(shards) < 40 else shards.values()) <= 1
    assert sorted((r.shard, r.slot) for r in left["sharding"]) == [(s, i) for s in sorted(shards) for i in range(shards[s])]

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(map(str, whole)) == Counter(map(str, left["sharding"]))


def test_stages_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null texts and clashing columns go through every stage, each judged on its own input."""
    folder = str(tmp_path / "sf")
    _, _, items = tables(spark, folder)
    odd = odd_documents()
    odd += [(None, f"{items[0][1]} tail", "en", "b", 1), (12, items[0][1], None, None, None)]
    docs = clashing(spark.createDataFrame(odd, SCHEMA))
    columns = docs.columns
    seen = Counter(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.collect(), cluster.written(stage(spark, docs, folder))
        rows = docs.collect()
        if name != "sharding":
            assert docs.columns == columns and set(map(str, rows)) <= set(seen)
        if name == "toxicity":
            assert Counter(map(str, rows)) == seen  # nobody offends here
        if name == "ngram_jaccard_join":
            plain = [(i, *r[1:]) for i, r in enumerate(before)]
            classes = {i: c for i, c, _ in links_by_sets(plain)}
            left = Counter(classes[next(i for i, b in enumerate(before) if str(b) == str(r))] for r in rows)
            assert left == Counter(set(classes.values()))  # one row of each class
        if name == "decontamination":
            bad = [x[-1] for r in before for x in hits_by_force([tuple(r)], items)]
            assert Counter(map(str, rows)) == Counter(str(r) for r, b in zip(before, bad, strict=True) if not b) and any(bad)
        if name == "sharding":
            assert len(rows) == len(before) and {"size", "text_crc32", "shard", "slot"} <= set(docs.columns)
            assert all(isinstance(r.slot, int) for r in rows)


def test_pipeline_of_no_documents(spark, tmp_path):
    folder = str(tmp_path / "sf")
    tables(spark, folder)
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []


def test_entry_module_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_rest_of_the_library_does_not_import_this_subpackage():
    import subprocess

    code = "import sys, tenderlens.plans, tenderlens.streaming.ingest, tenderlens.sources.reference_data; sys.exit(any(m.startswith('tenderlens.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
