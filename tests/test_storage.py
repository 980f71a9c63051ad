"""Stored indexes, and where streams end."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contextquarry.operators.costs import CountCache, by_expression, count_tokens
from contextquarry.sources import snapshots
from contextquarry.streaming import sinks

DOCUMENT = {
    "repo": "port", "commit": "abc", "builtAt": "2026-01-01T00:00:00Z", "totalTokens": 7, "tokensCounted": True, "tokenSource": "count_tokens",
    "symbols": [
        {"id": f"a.py::{n}", "file": "a.py", "kind": "func", "name": n, "qualname": n, "lineStart": i, "lineEnd": i + 1, "signature": f"def {n}():", "docFirstLine": "é", "docRest": "", "body": "pass\n", "tokens": t}
        for i, (n, t) in enumerate((("z", {"signature": 1, "skeleton": 2, "full": 3}), ("b", None)))
    ],
    "edges": [{"from": "a.py::z", "to": "a.py::b", "kind": "call", "weight": 2}],
    "files": {"a.py": "def z():\n", "b.py": ""},
}


def content(snapshot):
    return {n: sorted(map(str, getattr(snapshot, n).select(*(x.split()[0] for x in s.split(", "))).collect())) for n, s in snapshots.TABLES.items()}


def test_documents_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/port.json").write_text(json.dumps(DOCUMENT, indent=1, ensure_ascii=False))
    first = snapshots.read_documents(spark, str(tmp_path / "in"))
    assert [r.id for r in first.symbols.orderBy("ord").collect()] == ["a.py::z", "a.py::b"]
    assert snapshots.load(spark, str(tmp_path / "none")) is None
    store = str(tmp_path / "store")
    snapshots.store(first, store)
    assert content(snapshots.load(spark, store)) == content(snapshots.load(spark, store, "port")) == content(first)
    snapshots.write_documents(snapshots.load(spark, store), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    plain = json.loads(json.dumps(DOCUMENT))
    del plain["symbols"][1]["tokens"]  # nulls are left out
    assert lines == [plain]

    other = snapshots.Snapshot(*(getattr(first, n).withColumn("repo", F.lit("other")) for n in snapshots.TABLES))
    snapshots.store(other, store)
    assert {r.repo for r in snapshots.load(spark, store).snapshots.collect()} == {"port", "other"}
    estimate = snapshots.Snapshot(first.snapshots.withColumn("token_source", F.lit("estimate")), first.symbols.limit(0), first.edges, first.files)
    with pytest.raises(ValueError, match="port"):
        snapshots.store(estimate, store)
    assert snapshots.load(spark, store, "port").symbols.count() == 2
    snapshots.store(estimate, store, downgrade=True)
    assert snapshots.load(spark, store, "port").snapshots.first().token_source == "estimate"


def test_versions_of_a_store(spark, tmp_path):
    """A store that fails before its end changes nothing; what was loaded can be stored; versions that nothing points at go."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/port.json").write_text(json.dumps(DOCUMENT))
    store = str(tmp_path / "store")
    first = snapshots.store(snapshots.read_documents(spark, str(tmp_path / "in")), store)
    before = content(snapshots.load(spark, store))
    held = snapshots.load(spark, store)
    # a version whose tables aren't all written
    spark.createDataFrame([("port", "x", "y", "call", 9)], "repo string, src string, dst string, kind string, weight bigint").write.partitionBy("repo").parquet(f"{store}/edges/version=broken")
    assert content(snapshots.load(spark, store)) == before
    broken = snapshots.Snapshot(held.snapshots, held.symbols.withColumn("name", F.raise_error(F.lit("no"))), held.edges, held.files)
    with pytest.raises(Exception, match="no"):
        snapshots.store(broken, store)
    assert content(snapshots.load(spark, store)) == before == content(snapshots.load(spark, store, "port"))
    renamed = snapshots.Snapshot(held.snapshots, held.symbols.withColumn("name", F.upper("name")), held.edges, held.files)
    second = snapshots.store(renamed, store)  # reads what it replaces
    assert {r.name for r in snapshots.load(spark, store).symbols.collect()} == {"Z", "B"} and content(held) == before
    assert content(snapshots.load_version(spark, store, first)) == before
    gone = snapshots.vacuum(spark, store)
    assert first in gone and "broken" in gone and second not in gone
    assert {r.name for r in snapshots.load(spark, store).symbols.collect()} == {"Z", "B"}
    assert snapshots.load(spark, store, "nowhere").symbols.count() == 0


def test_counted_costs_are_stored(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/port.json").write_text(json.dumps(DOCUMENT))
    read = snapshots.read_documents(spark, str(tmp_path / "in"))
    costs = count_tokens(read.symbols, CountCache(spark, str(tmp_path / "cache"), "length"), by_expression(F.length))
    when = snapshots.built_now(datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone(timedelta(hours=2))))
    assert when == "2026-01-02T01:04:05+00:00" and snapshots.built_now().endswith("+00:00")
    snapshots.store(snapshots.counted(read, costs.repos, costs.symbols, when), str(tmp_path / "store"))
    stored = snapshots.load(spark, str(tmp_path / "store"))
    meta = stored.snapshots.first()
    assert (meta.built_at, meta.tokens_counted, meta.token_source) == (when, True, "count_tokens")
    full = {r.id: r.tokens.full for r in stored.symbols.collect()}
    assert full == {s["id"]: len("\n".join(x for x in (s["signature"], s["docFirstLine"], s["docRest"], s["body"]) if x)) + 2 for s in DOCUMENT["symbols"]} and meta.total_tokens == sum(full.values())


def test_sinks(spark, tmp_path):
    turns = spark.createDataFrame([("r", "t", 1, "good", "done", 0.014), ("r", "t", 2, "", "done", 0.02), ("r", "t", 3, "bad", "error: mismatch", 1.0)], "repo string, task string, ts long, text string, state string, usd double")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = lambda: spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    for _ in range(2):  # a second run finds nothing new
        sinks.append_replays(stream(), str(tmp_path / "replays"), str(tmp_path / "c1")).awaitTermination(60)
        sinks.record_spend(stream(), str(tmp_path / "spend"), str(tmp_path / "c2")).awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "replays")).collect()] == ["good"]
    assert [r.cents for r in spark.read.parquet(str(tmp_path / "spend")).collect()] == [103]
