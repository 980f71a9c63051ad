"""The stored index against scores of all symbols."""

import random

from pyspark.sql import functions as F

from contextquarry.operators import bm25, postings
from contextquarry.operators.postings import Index

SYMBOL = "repo string, ord long, id string, name string, signature string, doc_first string, tokens struct<full:long>"
WORDS = [f"w{k}" for k in range(60)] + ["snake_case_name", "CamelCase", "x2y"]


def symbols(spark, seed, n=900):
    """Documents of two repos over many blocks, with common and rare words, equal texts and empty ones."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        said = lambda k: " ".join(WORDS[min(int(rng.expovariate(0.12)), len(WORDS) - 1)] for _ in range(rng.randint(0, k)))
        rows.append((f"r{i % 2}", i * 97, f"d{i}", said(3), said(12), said(6) if i % 4 else "", None))
    rows += [(f"r{i % 2}", 10**7 + i, f"same{i}", "w1", "w1 w2 CamelCase", "", None) for i in range(40)]
    return rows, spark.createDataFrame(rows, SYMBOL).repartition(3)


def brute(spark, frame, tasks, k):
    """The k best of each request, from the scores of all symbols."""
    scores = bm25.scores(frame, {i: t for i, (_, t) in tasks.items()}, keep=("repo", "ord", "id"), repos={i: r for i, (r, _) in tasks.items()})
    rows = {}
    for r in scores.where("score > 0").collect():
        rows.setdefault(r.request_id, []).append((-r.score, r.ord, r.id))
    return {i: [(x[1], x[2], round(-x[0], 9)) for x in sorted(v)[:k]] for i, v in rows.items()}


def from_index(spark, index, tasks, k):
    requests = spark.createDataFrame([(i, r, t) for i, (r, t) in tasks.items()], "request_id long, repo string, task string")
    out = {}
    for r in sorted(postings.top(index, requests, k).collect(), key=lambda r: (r.request_id, r["rank"])):
        out.setdefault(r.request_id, []).append((r.ord, r.id, round(r.score, 9)))
    return out


TASKS = {1: ("r0", "w1 w2"), 2: ("r1", "CamelCase w1 w1 w59"), 3: ("r0", "snake_case_name x2y w7 w8 w9"), 4: ("r1", "nothing of that"), 5: ("r0", ""), 6: ("none", "w1"), 7: ("r0", "w62 w55 w1")}


def test_index_is_what_scores_of_all_symbols_say(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert from_index(spark, index, TASKS, 5) == {} and index.generations() == []
    _, first = symbols(spark, 1)
    rows, second = symbols(spark, 2)
    assert index.update(first) == 1
    assert from_index(spark, index, TASKS, 5) == brute(spark, first, TASKS, 5)
    half = spark.createDataFrame(rows[::2], SYMBOL)
    assert index.update(half, whole=False) == 2  # the others stay
    mixed = first.join(half.select("repo", "ord"), ["repo", "ord"], "left_anti").unionByName(half)
    assert from_index(spark, index, TASKS, 7) == brute(spark, mixed, TASKS, 7)
    assert index.update(second) == 3
    for k in (1, 2000):
        assert from_index(spark, index, TASKS, k) == brute(spark, second, TASKS, k)
    assert index.update(second) == 4
    assert index.table("documents").where("gen = 4").count() == index.table("postings").where("gen = 4").count() == 0
    index.update(second.limit(0))
    assert from_index(spark, index, TASKS, 5) == {}


def test_a_generation_without_its_row_in_the_log_is_not_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    _, first = symbols(spark, 1, 100)
    index.update(first)
    want = from_index(spark, index, TASKS, 5)
    for name in postings.TABLES:  # an update that failed before its end
        index.table(name).drop("gen").write.parquet(f"{index.path}/{name}/gen=2")
    assert from_index(spark, index, TASKS, 5) == want
    assert index.update(first) == 2 and from_index(spark, index, TASKS, 5) == want


def test_a_thousand_requests_are_one_plan(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    _, first = symbols(spark, 3)
    index.update(first)
    rng = random.Random(4)
    tasks = {i: (f"r{i % 2}", " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))) for i in range(1000)}

    def plan(n):
        requests = spark.createDataFrame([(i, r, t) for i, (r, t) in list(tasks.items())[:n]], "request_id long, repo string, task string")
        return len(postings.top(index, requests, 10)._jdf.queryExecution().analyzed().toString())

    assert plan(1000) == plan(1)
    got = from_index(spark, index, tasks, 10)
    few = {i: tasks[i] for i in range(0, 1000, 50)}
    want = brute(spark, first, few, 10)
    assert {i: got[i] for i in few if i in got} == want and len(got) == 1000


def test_blocks_that_cannot_matter_are_skipped(spark, tmp_path):
    """One document says the rare word often; blocks without it can't have a better one."""
    rows = [("r", i, f"d{i}", "common", "common words", "", None) for i in range(20 * postings.WIDTH)] + [("r", 5, "best", "rare rare", "rare common", "", None)]
    frame = spark.createDataFrame([r for r in rows if r[1] != 5 or r[2] == "best"], SYMBOL)
    index = Index(spark, str(tmp_path / "index"))
    index.update(frame)
    requests = spark.createDataFrame([(1, "r", "rare common")], "request_id long, repo string, task string")
    got = postings.top(index, requests, 1)
    assert [r.id for r in got.collect()] == ["best"]
    kept = postings.blocks_of(index, requests, 1)
    assert kept.count() == 1 and index.table("postings").select("block").distinct().count() == 20
    assert kept.select(F.first("block")).first()[0] == 0
