"""Sets of seeds, fused ranks, the ceiling, counted costs, facts and tasks against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from contextquarry.operators import costs, evaluate, graph, validate
from contextquarry.sources.tasks import read_tasks, unknown_ids
from contextquarry.streaming import ceiling


def random_graph(spark, seed, nodes=70, n=160):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice("ab")): rng.randint(1, 4) for _ in range(n)}
    rows = [("r", a, b, k, w) for (a, b, k), w in edges.items() if a != b]
    scores = [(q, "r", i, f"n{i}", float(rng.choice([0, 0, 1, 2, 2, 2.5])) if q < 3 else 0.0) for q in range(4) for i in range(nodes)]
    return spark.createDataFrame(scores, "request_id long, repo string, ord long, id string, score double").repartition(3), spark.createDataFrame(rows, "repo string, src string, dst string, kind string, weight long")


def test_sets_of_seeds_say_what_paths_say(spark):
    scores, edges = random_graph(spark, 1)
    seeds = graph.top_seeds(scores, None)
    paths = graph.contributions(graph.reached(seeds, edges, 3, first_edge=False)).collect()
    _, found = graph.seed_sets(scores, edges, 3)
    assert {(r.request_id, r.node) for r in found.select("request_id", "node").distinct().collect()} == {(r.request_id, r.id) for r in paths}
    hops = {(r.request_id, r.seed, r.node): r.hop for r in graph.reached(seeds, edges, 3).collect()}
    named = {(r.request_id, r.num): r.id for r in graph._numbered(scores.where("score > 0")).collect()}
    assert len(named) == seeds.count()
    want = graph.hop_depth(scores, edges)
    got = graph.hop_depth_all(scores, edges)
    plain = lambda df: sorted((r.request_id, r.depth, r.recovered, r.best) for r in df.collect())
    assert plain(got) == plain(want) and len(hops) > 500
    # the spread by the heaviest edge
    best = {}
    for d in (1, 2, 3):
        for r in graph.contributions(graph.reached(seeds, edges, d, first_edge=False)).collect():
            best.setdefault((r.request_id, d), []).append(round(r.graph_score, 4))
    assert {(r.request_id, r.depth): r.spread for r in got.collect()} == {k: round(len(set(v)) / len(v), 6) for k, v in best.items()}
    assert graph.hop_depth_all(scores.limit(0), edges).count() == 0


def test_fused_ranks_from_prefixes(spark):
    rng = random.Random(7)
    rows, reached = [], []
    for q in (1, 2, 3):
        n = {1: 3000, 2: 40, 3: 700}[q]
        rows += [(q, f"d{i}", i, rng.choice([0.0, 0.0, rng.random(), 1.0])) for i in range(n)]
        reached += [(q, f"d{i}", rng.choice([0.5, rng.random()]), (i * 7919) % 10007) for i in rng.sample(range(n), n // 3)]
    scored = spark.createDataFrame(rows, "request_id long, id string, ord long, score double").repartition(5)
    contrib = spark.createDataFrame(reached, "request_id long, id string, graph_score double, first long").repartition(4)
    by_score = evaluate.places(scored, [F.desc("score"), "ord"], "place")
    for limit in (1, 10, 50):
        got = evaluate.rank_rrf(by_score, contrib, limit).collect()
        for q in (1, 2, 3):
            a = {r[1]: k for k, r in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[2])))}
            b = {r[1]: k for k, r in enumerate(sorted((r for r in reached if r[0] == q), key=lambda r: (-r[2], r[3])))}
            fused = {i: 1 / (evaluate.RRF_K + a[i]) + (1 / (evaluate.RRF_K + b[i]) if i in b else 0.0) for i in a}
            want = sorted(fused, key=lambda i: (-fused[i], a[i]))[:limit]
            assert [r.id for r in sorted((r for r in got if r.request_id == q), key=lambda r: r["rank"])] == want


def brute_ceiling(batches, limit, shares, share_of):
    spent, out = 0, {}
    for rows in batches:
        left = max(0, limit - spent)
        used = [0] * shares
        for turn, ts, cents in sorted(rows, key=lambda r: (r[1], r[0])):
            s = share_of(turn)
            lease = left // shares + (s < left % shares)
            out[turn] = used[s] < lease
            used[s] += cents * out[turn]
        spent += sum(used)
    return out, spent


def test_a_ceiling_over_restarts(spark, tmp_path):
    rng = random.Random(2)
    batches, shares, limit, dearest = [], 8, 2500, 40
    for b in range(6):
        batches.append([(b * 1000 + i, b * 100 + rng.randint(0, 50), rng.randint(0, dearest)) for i in range(60)])
    path, turns, mark = str(tmp_path / "ledger"), str(tmp_path / "turns"), str(tmp_path / "mark")
    schema = "turn_id long, ts timestamp, cents long"

    def add(rows):
        spark.createDataFrame(rows, "turn_id long, s long, cents long").select("turn_id", F.timestamp_seconds("s").alias("ts"), "cents").coalesce(1).write.mode("append").parquet(turns)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(turns)
        ceiling.hold_ceiling(stream, path, mark, limit, shares).awaitTermination(120)

    ledger = ceiling.Ledger(spark, path)
    for part in (batches[:2], batches[2:4], batches[4:]):  # two restarts
        for rows in part:
            add(rows)
        run()
        if part is batches[2:4] or len(ledger.settled().collect()) == 4:
            # the last batch's commit is lost: it is run again, and decides as before
            before = {r.turn_id: r.allowed for r in ledger.decisions().collect()}
            (tmp_path / "mark/commits/3").unlink()
            for f in (tmp_path / "mark/commits").glob(".3*"):
                f.unlink()
            run()
            assert {r.turn_id: r.allowed for r in ledger.decisions().collect()} == before
    got = {r.turn_id: r for r in ledger.decisions().collect()}
    want, spent = brute_ceiling(batches, limit, shares, lambda t: got[t].share)
    assert {t: r.allowed for t, r in got.items()} == want
    assert sum(r.cents for r in got.values() if r.allowed) == spent == ledger.settled().agg(F.sum("cents")).first()[0]
    assert limit * 0.9 < spent <= limit + shares * dearest and not all(want.values())


SYMBOL = "repo string, ord long, signature string, doc_first string, doc_rest string, body string"


def test_counts_are_asked_once_and_repos_are_counted_whole(spark, tmp_path):
    rows = [("a", 1, "x", "", "", ""), ("a", 2, "x", "y", "z", "w"), ("b", 1, "x", "", "", "bad"), ("b", 2, "fine", "", "", "")]
    calls = str(tmp_path / "calls")

    def count(texts):
        with open(calls, "a") as f:  # tests run on one machine
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [None if "bad" in t else len(t) for t in texts]

    def asked():
        return sorted(json.loads(x) for x in open(calls))

    cache = costs.CountCache(spark, str(tmp_path / "cache"), "length")
    frame = spark.createDataFrame(rows, SYMBOL)
    got = costs.count_tokens(frame, cache, costs.by_batches(count))
    assert asked() == sorted({"x\n\n", "x\ny\n\n", "x\ny\nz\nw\n\n", "x\nbad\n\n", "fine\n\n"})
    assert {(r.repo, r.ord): r.tokens and tuple(r.tokens) for r in got.symbols.collect()} == {("a", 1): (3, 3, 3), ("a", 2): (3, 5, 9), ("b", 1): None, ("b", 2): None}
    assert {tuple(r) for r in got.repos.collect()} == {("a", True, "count_tokens", 12), ("b", False, None, 0)}
    again = costs.count_tokens(frame, cache, costs.by_batches(count))
    assert asked().count("x\nbad\n\n") == 2 and len(asked()) == 6
    mended = costs.count_tokens(frame.withColumn("body", F.regexp_replace("body", "bad", "good")), cache, costs.by_batches(count))
    assert {r.repo: r.total_tokens for r in mended.repos.collect()} == {"a": 12, "b": 14} and again.asked.count() == 1
    other = costs.CountCache(spark, str(tmp_path / "cache"), "ones")  # another counter's counts are its own
    assert costs.count_tokens(frame, other, costs.by_expression(lambda t: F.lit(1))).asked.count() == 5


def test_facts(spark):
    symbols = spark.createDataFrame([("r", "Client", "a.py"), ("r", "Client", "b.py"), ("r", "Client", "b.py"), ("r", "x", "a.py")], "repo string, name string, file string")
    edges = spark.createDataFrame([("r", "a", "b", "call", 2), ("r", "a", "b", "import", 1), ("r", "a", "c", "call", 5), ("r", "d", "b", "call", 1)], "repo string, src string, dst string, kind string, weight long")
    facts = [
        (1, "r", "edge", "call", "a", "b", 2), (2, "r", "edge", "call", "a", "b", 3), (3, "r", "edge", None, "a", "b", 3), (4, "r", "edge", "call", "a", "z", 1), (5, "r", "edge", "call", "z", "b", None),
        (6, "r", "name", None, "Client", "a.py", 1), (7, "r", "name", None, "Client", "c.py", 1), (8, "r", "count", "call", None, None, 3), (9, "r", "count", None, None, None, 5), (10, "r", "absent", "call", None, "c", None), (11, "r", "absent", "import", None, "c", None),
    ]
    got = {r.fact_id: tuple(r)[1:] for r in validate.check_facts(symbols, edges, spark.createDataFrame(facts, validate.FACT)).collect()}
    assert got == {
        1: (True, 2, None), 2: (False, 2, "c"), 3: (True, 3, None), 4: (False, 0, "c"), 5: (False, 0, None), 6: (True, 1, None), 7: (False, 0, "b.py"), 8: (True, 3, None), 9: (False, 4, None), 10: (False, 1, "a"), 11: (True, 0, None),
    }
    with pytest.raises(Exception, match="no such fact: guess"):
        validate.check_facts(symbols, edges, spark.createDataFrame([(1, "r", "guess", None, None, None, 1)], validate.FACT)).collect()


def test_tasks_from_files(spark, tmp_path):
    good = {"repo": "r", "task": "do it", "expect": ["a", "b", "a"], "why": "because"}
    (tmp_path / "one.json").write_text(json.dumps([good, 7, {**good, "repo": ""}, {**good, "task": None}, {**good, "expect": []}, {**good, "expect": "a"}], indent=2))
    (tmp_path / "object.json").write_text(json.dumps({**good, "task": "alone"}, indent=2))
    (tmp_path / "lines.json").write_text("\n".join([json.dumps({**good, "task": "line"}), "", "{broken", "null", json.dumps({"repo": "r", "task": "no why", "expect": ["c"]})]))
    (tmp_path / "empty.json").write_text("")
    tasks, malformed = read_tasks(spark, str(tmp_path))
    name = lambda r: r.file.rsplit("/", 1)[1]
    assert sorted((name(r), r["at"], r.task, tuple(r.expect), r.why) for r in tasks.collect()) == [
        ("lines.json", 0, "line", ("a", "b"), "because"), ("lines.json", 3, "no why", ("c",), None), ("object.json", 0, "alone", ("a", "b"), "because"), ("one.json", 0, "do it", ("a", "b"), "because"),
    ]
    assert sorted((name(r), r["at"], r.reason) for r in malformed.collect()) == [
        ("lines.json", 1, "not JSON"), ("lines.json", 2, "not an object"), ("one.json", 1, "not an object"), ("one.json", 2, "repo"), ("one.json", 3, "task"), ("one.json", 4, "expect"), ("one.json", 5, "expect"),
    ]
    known = spark.createDataFrame([("r", "a"), ("r", "c"), ("other", "b")], "repo string, id string")
    assert sorted((name(r), r.id) for r in unknown_ids(tasks, known).collect()) == [("lines.json", "b"), ("object.json", "b"), ("one.json", "b")]
