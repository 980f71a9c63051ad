"""Ranking and packs against brute force on a small graph, streams, the code index, and queries against their SQL."""

import json
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from contextquarry import catalog
from contextquarry.functions.text import split_doc, tokenize, tokens
from contextquarry.operators import bm25, code_index, graph, packer, serve
from contextquarry.plans import sample_package
from contextquarry.plans.pack import pack
from contextquarry.streaming import turns

SYMBOL = "repo string, ord long, id string, file string, kind string, name string, signature string, doc_first string, doc_rest string, body string, tokens struct<signature:long,skeleton:long,full:long>"
REQUEST = "request_id long, repo string, task string, budget long, pins array<string>, evicts array<string>"
#: id, name, signature, first line of documentation, costs of the signature and of all
SEVEN = [
    ("tide.py::TideTable", "TideTable", "class TideTable(Table):", "High water by harbour", 24, 210),
    ("tide.py::next_high_water", "next_high_water", "def next_high_water(harbour, after):", "First high water of a harbour", 18, 95),
    ("port.py::Harbour", "Harbour", "class Harbour:", "", 9, 75),
    ("port.py::moor", "moor", "def moor(ship, harbour):", "", 12, 60),
    ("ship.py::Ship", "Ship", "class Ship:", "Draught and length", 14, 130),
    ("ship.py::fits_lock", "fits_lock", "def fits_lock(ship, lock):", "", 16, 40),
    ("log.py::LogBook", "LogBook", "class LogBook:", "Entries by day", 15, 90),
]
TABLE, NEXT, HARBOUR, MOOR, SHIP, LOCK, LOG = (s[0] for s in SEVEN)
LINKS = [(MOOR, HARBOUR, "annotation", 4), (MOOR, SHIP, "annotation", 1), (LOCK, SHIP, "annotation", 1), (NEXT, TABLE, "call", 2), (NEXT, HARBOUR, "annotation", 1)]
TASK = "when is high water in the harbour"
COST = {s[0]: {"signature": s[4], "skeleton": s[4] + 3, "full": s[5]} for s in SEVEN}


@pytest.fixture(scope="module")
def seven(spark):
    rows = [("port", i, s[0], s[0].split("::")[0], "func", s[1], s[2], s[3], "", "", tuple(COST[s[0]].values())) for i, s in enumerate(SEVEN)]
    links = [("port", *e) for e in LINKS]
    return spark.createDataFrame(rows, SYMBOL), spark.createDataFrame(links, "repo string, src string, dst string, kind string, weight long")


def brute_scores(task):
    total = [0.0] * len(SEVEN)
    for weight, texts in ((3, [s[1] for s in SEVEN]), (1, [f"{s[2]} {s[3]}" for s in SEVEN])):
        docs = [tokenize(t) for t in texts]
        mean = max(sum(map(len, docs)) / len(docs), 1)
        for term in tokenize(task):
            n = sum(term in d for d in docs)
            for i, d in enumerate(docs):
                tf = d.count(term)
                total[i] += weight * math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
    return dict(zip(COST, total, strict=True))


def brute_contributions(scores, hops):
    """id -> (score, hops, seed)"""
    near = {i: [] for i in scores}
    for a, b, kind, w in sorted(LINKS):
        near[a].append(((a, b, kind, 0), b, w))
        near[b].append(((a, b, kind, 1), a, w))
    best = {}
    for seed in sorted((i for i in scores if scores[i] > 0), key=lambda i: -scores[i]):
        seen, front = {seed}, [seed]
        for hop in range(1, hops + 1):
            new = []
            for node in front:
                for _, other, w in sorted(near[node]):
                    if other not in seen:
                        seen.add(other)
                        new.append(other)
                        score = scores[seed] * 0.5**hop * math.log(1 + w)
                        if other not in best or score > best[other][0]:
                            best[other] = (score, hop, seed)
            front = new
    return best


def brute_pack(task, budget, pins, evicts, hops=1):
    scores = brute_scores(task)
    graph = brute_contributions(scores, hops)
    final = {i: max(scores[i], graph.get(i, (0,))[0]) for i in scores}
    reason = {i: f"graph:{graph[i][1]} from {graph[i][2]}" if i in graph and graph[i][0] > scores[i] else "bm25" for i in scores}
    left, selected, out = int(budget * 0.995), [], {}
    pins = list(dict.fromkeys(pins))
    for i in [*pins, *sorted((i for i in scores if i not in pins and i not in evicts), key=lambda i: -final[i])]:
        tier = next((t for t in ("full", "skeleton", "signature") if COST[i][t] <= left), None)
        if i not in pins and final[i] <= 0:
            out[i] = "no match for this task"
        elif tier is None:
            out[i] = "kept, but no budget left" if i in pins else "ran out of budget"
        else:
            why = reason[i] if i not in pins else "kept" if tier == "full" else f"kept (degraded to {tier}: full did not fit)"
            selected.append((i, tier, COST[i][tier], why))
            left -= COST[i][tier]
    return selected, out


CASES = {
    "parse_http_date": ["parse_http_date", "parse", "http", "date"],
    "TideTable": ["tidetable", "tide", "table"],
    "XMLReader": ["xmlreader", "xml", "reader"],
    "_x": ["_x", "x"],
    "___": ["___"],
    "go_go": ["go_go", "go", "go"],
    "PDF3Reader": ["pdf3reader"],
    "v12b": ["v12b", "v", "12", "b"],
    "re-use it": ["re", "use", "it"],
    "naïve": ["na", "ve"],
    "": [],
}


def test_tokens(spark):
    rng = random.Random(1)
    texts = [*CASES, *("".join(rng.choice("aBcD_1 -é") for _ in range(12)) for _ in range(300))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("x")).collect()
    assert all(r.x == tokenize(r.t) for r in got)
    assert {t: tokenize(t) for t in CASES} == CASES


def test_bm25_and_graph(seven):
    symbols, edges = seven
    want = brute_scores(TASK)
    scores = bm25.scores(symbols, {1: TASK})
    assert {r.id: r.score for r in scores.collect()} == pytest.approx(want)
    for hops in (1, 2):
        contrib = graph.contributions(graph.reached(graph.top_seeds(scores), edges, hops)).collect()
        found = brute_contributions(want, hops)
        assert {r.id: (r.hops, r.from_id) for r in contrib} == {i: x[1:] for i, x in found.items()}
        assert {r.id: r.graph_score for r in contrib} == pytest.approx({i: x[0] for i, x in found.items()})


def test_heaviest_edge(spark):
    links = spark.createDataFrame([("r", "a", "b", "x", 1), ("r", "a", "b", "y", 9)], "repo string, src string, dst string, kind string, weight long")
    seeds = spark.createDataFrame([(1, "r", "a", 1, 2.0)], "request_id long, repo string, seed string, seed_rank int, seed_score double")
    got = [graph.reached(seeds, links, 1, first).first().score for first in (True, False)]
    assert got == pytest.approx([math.log(2), math.log(10)])


def test_packs(spark, seven):
    requests = [(1, 300, [], []), (2, 300, [LOG], []), (3, 300, [], [HARBOUR]), (4, 4000, [], []), (5, 300, [SHIP, SHIP], [SHIP]), (6, 62, [TABLE, LOCK, LOG], []), (7, 130, [], []), (8, 30, [NEXT, LOG, MOOR], [])]
    asked = spark.createDataFrame([(i, "port", TASK, b, p, e) for i, b, p, e in requests], REQUEST)
    p = pack(*seven, asked)
    selected, evicted, totals = p.selected.collect(), p.evicted.collect(), {r.request_id: r.total for r in p.totals.collect()}
    for i, budget, pins, evicts in requests:
        want, out = brute_pack(TASK, budget, pins, evicts)
        assert [(r.id, r.tier, r.tokens, r.reason) for r in sorted((r for r in selected if r.request_id == i), key=lambda r: r.pos)] == want
        assert {r.id: r.reason for r in evicted if r.request_id == i} == out
        assert totals[i] == sum(x[2] for x in want) <= budget
    reasons = {x[3].split(" ")[0] for r in requests for x in brute_pack(TASK, *r[1:])[0]}
    assert reasons == {"bm25", "graph:1", "kept"}


def test_no_requests(spark, seven):
    p = pack(*seven, spark.createDataFrame([], REQUEST))
    assert [df.count() for df in (p.selected, p.evicted, p.totals, p.candidates)] == [0, 0, 0, 0]
    blank = pack(*seven, spark.createDataFrame([(1, "port", "", 300, [], []), (2, "nowhere", "water", 300, [], [])], REQUEST))
    assert blank.selected.count() == 0 and {(r.request_id, r.reason) for r in blank.evicted.collect()} == {(1, "no match for this task")}


def test_fill_in_rounds_is_the_sequential_loop(spark):
    rng = random.Random(5)
    rows, budget = [], {1: 500, 2: 3000}
    for i in (1, 2):
        for k in range(300):
            s = rng.randint(0, 8)
            rows.append((i, f"x{k}", k, (s, s + rng.randint(0, 9), s + rng.randint(0, 90)), float(rng.randint(0, 20)), "bm25", None))
    df = spark.createDataFrame(rows, "request_id long, id string, ord long, tokens struct<signature:long,skeleton:long,full:long>, final double, reason string, pin int")
    asked = spark.createDataFrame([(i, "r", "", b, [], []) for i, b in budget.items()], REQUEST)
    want = set()
    for i in budget:
        left, pos = int(budget[i] * packer.RESERVE), 0
        for r in sorted((r for r in rows if r[0] == i and r[4] > 0), key=lambda r: (-r[4], r[2])):
            for tier, cost in zip(("full", "skeleton", "signature"), reversed(r[3]), strict=True):
                if 0 < cost <= left:
                    want.add((i, pos, r[1], tier, cost))
                    left, pos = left - cost, pos + 1
                    break
    for size in (20_000, 40):
        assert {(r.request_id, r.pos, r.id, r.tier, r.tokens) for r in packer.fill(df, asked, size).collect()} == want


def test_quota_window(spark):
    hits = spark.createDataFrame([(1, s * 1_000_000, i) for i, s in enumerate((0, 10, 20, 30, 86_399, 86_400))], "key long, micros long, hit_id long")
    got = sorted(serve.quota(hits).collect(), key=lambda r: r.hit_id)
    assert [r.allowed for r in got] == [True, True, True, False, False, True]


def _run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_quota_stream(spark, tmp_path):
    rows = [("u", i, s) for i, s in enumerate((0, 10, 20, 30, 86_399, 86_400))]
    df = spark.createDataFrame(rows, "key string, hit_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    for lot in (df.where("hit_id < 2"), df.where("hit_id >= 2")):
        lot.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path))
    got = sorted(_run(spark, turns.quota_stream(stream), "append", "quota"), key=lambda r: r.hit_id)
    assert [r.allowed for r in got] == [True, True, True, False, False, True]


def test_code_index_of_the_json_package(spark):
    parsed = code_index.parse(code_index.scan(spark, os.path.dirname(json.__file__))).cache()
    symbols, edges = code_index.symbols(parsed), code_index.edges(parsed)
    assert symbols.count() == 31 and edges.count() == 23
    assert symbols.select("id").distinct().count() == 31


@pytest.mark.parametrize("name", ["snapshot_scan", "tokenize", "bm25_fielded", "edge_collapse", "graph_contrib_d2", "graph_contrib_heaviest", "recall_grid", "recall_at_k", "recall_by_kind", "sse_frames", "sse_text", "replay_fallback", "validated_messages", "tool_dispatch", "display_list", "model_names", "client_keys", "pack_selected", "pack_totals", "rank_rrf", "request_admission", "usage_last_wins", "cost_projection", "quota_decisions", "validate_graph", "code_symbols", "code_exports", "code_edges", "sample_edges", "src_scan", "turn_frames", "turn_events", "counted_costs", "self_check", "task_files", "pack_documents", "index_statistics", "ceiling_leases"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert plain(got.collect()) == plain(want)


def test_sample_package(spark):
    parsed = code_index.parse(spark.createDataFrame(list(sample_package.FILES.items()), "file string, content string")).cache()
    plain = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    assert plain(code_index.symbols(parsed), "id", "kind", "line_start", "line_end", "signature", "doc_first", "doc_rest", "body") == sorted(sample_package.SYMBOLS)
    assert plain(code_index.exports(parsed, code_index.modules(parsed)), "file", "name", "at_file", "at_name") == sorted(sample_package.EXPORTS)
    assert plain(code_index.edges(parsed), "src", "dst", "kind", "weight") == sorted(sample_package.EDGES)


def test_files_that_do_not_parse(spark):
    files = spark.createDataFrame([("a/x.py", "def f(:"), ("a/y.py", "x = 1"), ("a/z.py", None)], "file string, content string")
    with pytest.raises(Exception, match="a/x.py doesn't parse"):
        code_index.parse(files).collect()
    got = {r.file: (len(r.symbols), r.error is None) for r in code_index.parse(files, strict=False).collect()}
    assert got == {"a/x.py": (0, False), "a/y.py": (1, True), "a/z.py": (1, True)}


def test_package_root(tmp_path):
    for name in ("tests", "test", "docs", "examples", "scripts", ".hidden", "no_package"):
        (tmp_path / name).mkdir()
        if name != "no_package":
            (tmp_path / name / "__init__.py").touch()
    with pytest.raises(ValueError):
        code_index.package_root(str(tmp_path))
    (tmp_path / "own").mkdir()
    (tmp_path / "own/__init__.py").touch()
    assert code_index.package_root(str(tmp_path)) == code_index.package_root(str(tmp_path / "own")) == str(tmp_path / "own")
    (tmp_path / "more").mkdir()
    (tmp_path / "more/__init__.py").touch()
    with pytest.raises(ValueError):
        code_index.package_root(str(tmp_path))


def test_split_doc(spark):
    texts = ["one", "\n  \n two\nthree\n\nfour", "", None, " \n "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*split_doc(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("one", ""), (" two", "three\n\nfour"), ("", ""), ("", ""), ("", "")]


def test_usage_stream(spark, tmp_path):
    schema = "turn_id long, frame_no long, prompt long, candidates long, thoughts long, total long"
    rows = [(1, 0, 6, None, None, 7), (1, 2, None, 5, None, 11), (2, 0, None, None, None, None), (1, 1, 7, 3, None, 10)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path))
    got = {r.turn_id: tuple(r)[1:] for r in _run(spark, turns.usage_stream(stream), "complete", "usage")}
    assert got == {1: (7, 5, None, 11), 2: (None, None, None, None)}


def test_every_query_has_sql():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) == set(queries)
