"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter, defaultdict

import pytest
from test_operators import brute_classes, split

import corpus_pipeline
from contextquarry.llm import quality
from contextquarry.scratch import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs.collect())
        docs = materialize(stage(spark, docs, sf), "stage")
        if name != "sharding":
            assert docs.columns == columns
    inputs.append(docs.collect())
    raw, good, distinct, clean, mixed, shards = inputs

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    known = [r.doc_id for r in raw if quality.get(r.doc_id) == 1]
    assert sum(d in kept for d in known) >= 0.97 * len(known)
    assert sum(d not in kept for d in quality if quality[d] == 0) >= 0.7 * sum(q == 0 for q in quality.values())

    assert {r.doc_id for r in distinct} == {c for _, c, _, _ in brute_classes([(r.doc_id, r.text) for r in good])}

    items = [split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(i[k : k + 8]) for i in items for k in range(len(i) - 7)}
    leaky = {r.doc_id for r in distinct if sum(tuple(w[k : k + 8]) in grams for w in [split(r.text)] for k in range(len(w) - 7)) >= 8}
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - leaky

    size, took = Counter(), Counter()
    for r in clean:
        size[r.source] += len(split(r.text))
    for r in mixed:
        took[r.source] += len(split(r.text))
    largest = max(len(split(r.text)) for r in clean)
    assert abs(sum(took.values()) - sum(size.values())) <= largest * len(size)
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3

    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in mixed)
    place, total = defaultdict(set), Counter()
    for r in shards:
        place[r.doc_id].add(r.shard)
        total[r.shard] += r.size
    assert all(len(p) == 1 for p in place.values())
    assert max(total.values()) - min(total.values()) <= 3 * max(r.size for r in shards)


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "shard", "slot"} <= set(got.columns) and got.count() > 0


def test_stages_take_odd_rows(spark, sf, odd):
    """Null ids and texts, repeated rows, and columns with the operators' own names, in every stage."""
    texts = {r.text for r in odd.collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        if name != "sharding":
            assert got.columns == odd.columns
            assert {r.text for r in got.collect()} <= texts
    assert {r.text for r in corpus_pipeline.near_duplicates(spark, odd, sf).collect()} < texts


def test_run_on_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_scores_pairs_of_words(monkeypatch):
    asked = {}

    def spy(*_, **options):
        asked.update(options)
        raise InterruptedError

    monkeypatch.setattr(quality, "score_documents", spy)
    with pytest.raises(InterruptedError):
        quality.good_documents(None, None)
    assert asked["order"] == 2
