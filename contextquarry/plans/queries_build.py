"""Queries of what is built and checked: counted costs, facts, answers as documents, tasks from files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from contextquarry.catalog import query
from contextquarry.functions.text import render_sql
from contextquarry.operators.costs import CountCache, by_expression, count_tokens
from contextquarry.operators.validate import FACT, check_facts
from contextquarry.plans.answers import answers, read_answers
from contextquarry.plans.queries_context import _TOTALS, EDGES, PACKED, _edges, _pack
from contextquarry.plans.queries_evaluate import grid, grid_sql
from contextquarry.scratch import materialize, scratch
from contextquarry.sources import tables as T
from contextquarry.sources.tasks import read_tasks, unknown_ids

# counted costs

_PIECES = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"
#: What the counter can't count here.
_FAILS = "Brand#13"
_TIER_TEXTS = ", ".join(f"('{t}', {render_sql(t)})" for t in ("signature", "skeleton", "full"))


@query(
    "counted_costs",
    f"""WITH {T.SYMBOLS}, texts AS (SELECT s.repo, s.ord, t.tier, t.text, CASE WHEN NOT contains(t.text, '{_FAILS}') THEN len(regexp_extract_all(t.text, '{_PIECES}')) END AS tokens FROM symbols s, LATERAL (VALUES {_TIER_TEXTS}) t(tier, text))
    SELECT repo, bool_and(tokens IS NOT NULL) AS tokens_counted, CASE WHEN bool_and(tokens IS NOT NULL) THEN 'count_tokens' END AS token_source,
           CASE WHEN bool_and(tokens IS NOT NULL) THEN sum(tokens) FILTER (tier = 'full') ELSE 0 END::BIGINT AS total_tokens, CASE WHEN bool_and(tokens IS NOT NULL) THEN count(DISTINCT ord) ELSE 0 END AS with_costs,
           (SELECT count(DISTINCT text) FROM texts) AS asked, (SELECT count(DISTINCT text) FROM texts WHERE tokens IS NULL) AS asked_again FROM texts GROUP BY repo""",
)
def counted_costs(spark, d):
    """Costs by a counter that fails for some texts of one repo, twice with one cache: the second run only asks what has failed."""
    symbols = T.symbols(spark, d, True)
    counter = by_expression(lambda text: F.when(~F.contains(text, F.lit(_FAILS)), F.size(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)))))
    cache = CountCache(spark, f"{scratch(spark)}/counts-{uuid.uuid4().hex[:12]}", "pieces")
    first = count_tokens(symbols, cache, counter)
    again = count_tokens(symbols, cache, counter)
    number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    costs = again.symbols.groupBy("repo").agg(F.count("tokens").alias("with_costs"))
    rows = again.repos.join(costs, "repo")
    return rows.crossJoin(F.broadcast(number(first.asked, "asked"))).crossJoin(F.broadcast(number(again.asked, "asked_again")))  # one row each


# facts

#: Of the graph of supplies: some hold, some don't.
FACTS = [
    (1, "parts", "edge", None, "s:1", "p:1", 1), (2, "parts", "edge", "N", "s:2", "p:2", 2), (3, "parts", "edge", "R", "s:3", "p:none", 1), (4, "parts", "edge", "A", "s:none", "p:1", 1),
    (5, "parts", "name", None, "Supplier#000000001", "suppliers", 1), (6, "parts", "name", None, "Supplier#000000001", "Brand#13", 1), (7, "parts", "name", None, "no such name", "suppliers", 1),
    (8, "parts", "count", "N", None, None, 1000), (9, "parts", "count", None, None, None, 10**12), (10, "parts", "absent", None, None, "s:1", None), (11, "parts", "absent", "N", None, "p:1", None), (12, "nowhere", "count", "N", None, None, 1),
]
_literal = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_FACTS = ", ".join(f"({', '.join(map(_literal, row))})" for row in FACTS)


@query(
    "self_check",
    f"""WITH {T.PART_SYMBOLS},{EDGES}, facts AS (SELECT fact_id::BIGINT AS fact_id, repo, fact, kind, source, target, least FROM (VALUES {_FACTS}) t(fact_id, repo, fact, kind, source, target, least)),
    e AS (SELECT f.fact_id, e.dst, f.target, sum(e.weight) AS w FROM facts f JOIN edges e ON f.fact = 'edge' AND e.repo = f.repo AND e.src = f.source AND (f.kind IS NULL OR e.kind = f.kind) GROUP BY ALL),
    n AS (SELECT f.fact_id, s.file, f.target, count(*) AS w FROM facts f JOIN part_symbols s ON f.fact = 'name' AND s.repo = f.repo AND s.name = f.source GROUP BY ALL),
    a AS (SELECT f.fact_id, e.src, e.weight FROM facts f JOIN edges e ON f.fact = 'absent' AND e.repo = f.repo AND e.dst = f.target AND (f.kind IS NULL OR e.kind = f.kind)),
    found AS (
      SELECT fact_id, max(w) FILTER (dst = target) AS n, arg_max(dst, (w, dst)) FILTER (dst <> target) AS nearest FROM e GROUP BY fact_id
      UNION ALL SELECT fact_id, max(w) FILTER (file = target), arg_max(file, (w, file)) FILTER (file <> target) FROM n GROUP BY fact_id
      UNION ALL SELECT f.fact_id, count(*), NULL FROM facts f JOIN edges e ON f.fact = 'count' AND e.repo = f.repo AND (f.kind IS NULL OR e.kind = f.kind) GROUP BY f.fact_id
      UNION ALL SELECT fact_id, count(*), arg_max(src, (weight, src)) FROM a GROUP BY fact_id),
    judged AS (SELECT f.fact_id, coalesce(x.n, 0)::BIGINT AS found, x.nearest, CASE f.fact WHEN 'absent' THEN coalesce(x.n, 0) = 0 ELSE coalesce(x.n, 0) >= greatest(1, coalesce(f.least, 1)) END AS ok FROM facts f LEFT JOIN found x ON x.fact_id = f.fact_id)
    SELECT fact_id, ok, found, CASE WHEN NOT ok THEN nearest END AS nearest FROM judged""",
)
def self_check(spark, d):
    return check_facts(T.part_symbols(spark, d), _edges(spark, d), spark.createDataFrame(FACTS, FACT))


# answers

_LISTS = "SELECT request_id, 'selected' AS list, pos, id, tier, tokens, reason FROM selected UNION ALL SELECT request_id, 'evicted', NULL, id, NULL, tokens, reason FROM evicted"


@query("pack_documents", f"WITH RECURSIVE {PACKED} {_LISTS}")
def pack_documents(spark, d):
    """The lists of packs, read back from their JSON documents and parts."""
    selected, evicted, _ = read_answers(*_answers(spark, d))
    kept = selected.select("request_id", F.lit("selected").alias("list"), "pos", "id", "tier", "tokens", "reason")
    return kept.unionByName(evicted.withColumn("list", F.lit("evicted")), allowMissingColumns=True)


@query("pack_document_totals", f"WITH RECURSIVE {PACKED},{_TOTALS} SELECT * FROM totals")
def pack_document_totals(spark, d):
    return read_answers(*_answers(spark, d))[2]


def _answers(spark, d):
    requests = T.requests(spark, d)
    found, parts = answers(_pack(spark, d), requests)
    return materialize(found, "answers"), materialize(parts, "evicted-parts")


# tasks from files

#: Rows that say no task, and what is wrong with them.
MALFORMED = ["{not json", "[1, 2]", '"text"', '{"task": "x", "expect": ["p:1"]}', '{"repo": "parts", "task": " ", "expect": ["p:1"]}', '{"repo": "parts", "task": "x", "expect": []}', '{"repo": "parts", "task": "x", "expect": ["p:1", 2]}', '{"repo": 7, "task": "x", "expect": ["p:1"]}']
REASONS = ["not JSON", "not an object", "not an object", "repo", "task", "expect", "expect", "repo"]
#: What the tasks of a file expect: places of symbols, one of which isn't there.
TASKS = [(1, "documents", "the and of tion", [3, 5, 7]), (2, "documents", "worthless idiot", [1, 2]), (6, "parts", "red widget", [6, 12, 18]), (7, "parts", "small ring PROMO red", [7, 14, 21, -1])]
_TASKS = ", ".join(f"({i}::BIGINT, '{r}', '{t}', {o}::BIGINT[])" for i, r, t, o in TASKS)
_TASKED = f"""tasked AS (SELECT * FROM (VALUES {_TASKS}) t(request_id, repo, task, ords)),
expected AS (SELECT x.request_id, coalesce(s.id, 'none:' || x.ord) AS id, s.kind FROM (SELECT request_id, repo, unnest(ords) AS ord FROM tasked) x LEFT JOIN symbols s ON s.repo = x.repo AND s.ord = x.ord)"""


def _task_files(spark, d):
    """TASKS as a JSON array, and MALFORMED and an empty line as lines, in the shared folder. A task's why is its number."""
    rows = spark.createDataFrame([(i, r, t, at, o) for i, r, t, ords in TASKS for at, o in enumerate(ords)], "request_id long, repo string, task string, at long, ord long")
    ids = rows.join(T.symbols(spark, d).select("repo", "ord", "id"), ["repo", "ord"], "left").select("request_id", "repo", "task", "at", F.coalesce("id", F.concat(F.lit("none:"), F.col("ord").cast("string"))).alias("id"))
    tasks = ids.groupBy("request_id", "repo", "task").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("expect"))
    item = F.struct("repo", "task", "expect", F.col("request_id").cast("string").alias("why"))
    path = f"{scratch(spark)}/tasks-{uuid.uuid4().hex[:12]}"
    tasks.agg(F.to_json(F.collect_list(item)).alias("value")).coalesce(1).write.text(f"{path}/good")  # a handful of tasks
    spark.createDataFrame([("\n".join([*MALFORMED, "", json.dumps({"repo": "parts", "task": "more", "expect": ["p:1", "p:1"]})]),)], "value string").coalesce(1).write.text(f"{path}/lines")
    return read_tasks(spark, f"{path}/*")


_REASONS = ", ".join(f"({i}::BIGINT, '{r}', '{row}')" for i, (r, row) in enumerate(zip(REASONS, MALFORMED, strict=True)))


@query(
    "task_files",
    f"""WITH {T.SYMBOLS},{_TASKED} SELECT 'task' AS part, t.task AS item, (SELECT string_agg(id, ' ' ORDER BY id) FROM expected e WHERE e.request_id = t.request_id) AS says, (SELECT count(*) FROM expected e WHERE e.request_id = t.request_id AND e.id LIKE 'none:%') AS n FROM tasked t
    UNION ALL SELECT 'task', 'more', 'p:1', 0 UNION ALL SELECT 'malformed', m.line, m.reason, m.place FROM (VALUES {_REASONS}) m(place, reason, line)""",
)
def task_files(spark, d):
    """Tasks that were written as JSON and read again, with the number of ids that aren't there, and rows that are malformed, with their place and reason."""
    tasks, malformed = _task_files(spark, d)
    none = unknown_ids(tasks, T.symbols(spark, d)).groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"))
    good = tasks.join(none, ["file", "at"], "left").select(F.lit("task").alias("part"), F.col("task").alias("item"), F.array_join(F.array_sort("expect"), " ").alias("says"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return good.unionByName(malformed.select(F.lit("malformed").alias("part"), F.col("row").alias("item"), F.col("reason").alias("says"), F.col("at").alias("n")))


@query("recall_grid_tasks", f"SELECT * FROM ({grid_sql(False, _TASKED)}) UNION ALL SELECT * FROM ({grid_sql(True, _TASKED)})")
def recall_grid_tasks(spark, d):
    """The grid of recall_grid for the tasks of a file and what they expect."""
    tasks = materialize(_task_files(spark, d)[0].where("why IS NOT NULL").withColumn("request_id", F.col("why").cast("long")), "tasks")
    want = tasks.select("request_id", F.explode("expect").alias("id"))
    return grid(spark, d, tasks.select("request_id", "repo", "task"), want)
