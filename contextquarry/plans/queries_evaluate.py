"""Queries of retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from contextquarry.catalog import query
from contextquarry.operators import bm25, evaluate, graph, packer
from contextquarry.plans.pack import fuse, scored
from contextquarry.plans.queries_context import BASE, EDGES, EXPANDED, _edges
from contextquarry.scratch import materialize
from contextquarry.sources import tables as T

TOP = 50
#: The language of each request's slice.
SLICES = {1: "en", 2: "en", 3: "fr", 4: "de", 5: "es"}
_SLICES = ", ".join(f"({k}::BIGINT, '{v}')" for k, v in SLICES.items())
#: What a request should find: all documents of its language that are labelled good, or some parts.
_EXPECTED = f"""expected AS (
  SELECT DISTINCT a.request_id, s.id, s.kind FROM asked a JOIN (VALUES {_SLICES}) x(request_id, lang) ON x.request_id = a.request_id
  JOIN symbols s ON s.repo = a.repo AND s.kind = x.lang JOIN labels l ON l.doc_id = s.ord AND l.quality = 1 WHERE a.repo = 'documents'
  UNION ALL SELECT a.request_id, s.id, s.kind FROM asked a JOIN symbols s ON s.repo = 'parts' AND a.repo = 'parts' AND s.ord IN (a.request_id, 2 * a.request_id, 3 * a.request_id, (1::BIGINT << 40) + 1))"""
_MAX = "ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final DESC, ord) AS rank FROM fused)"
_RECALL = "recalls AS (SELECT e.request_id, k, avg((coalesce(r.rank, 1000000000) <= k)::INT) AS recall FROM expected e LEFT JOIN ranked r ON r.request_id = e.request_id AND r.id = e.id, (VALUES (20::BIGINT), (50)) v(k) GROUP BY ALL)"


def expected(spark, d):
    asked = T.requests(spark, d).select("request_id", "repo")
    symbols = T.symbols(spark, d).select("repo", "ord", "id", "kind")
    good = T.table(spark, d, "labels").where("quality = 1").select(F.lit("documents").alias("repo"), F.col("doc_id").alias("ord")).distinct()
    slices = spark.createDataFrame(list(SLICES.items()), "request_id long, kind string")
    docs = symbols.join(good, ["repo", "ord"]).join(F.broadcast(slices), "kind").join(asked, ["request_id", "repo"]).select("request_id", "id", "kind")
    r = F.col("request_id")
    parts = asked.where("repo = 'parts'").select("request_id", "repo", F.explode(F.array(r, 2 * r, 3 * r, F.lit((1 << 40) + 1))).alias("ord"))
    return docs.unionByName(parts.join(symbols, ["repo", "ord"]).select("request_id", "id", "kind"))


def fused(spark, d):
    scores = scored(T.symbols(spark, d, True), T.requests(spark, d))
    contrib = graph.contributions(graph.reached(graph.top_seeds(scores), _edges(spark, d), 1))
    return materialize(fuse(scores, contrib), "fused")


def placed(scores):
    """Scores with the place of each in its request's list."""
    return evaluate.places(scores.select("request_id", "ord", "id", "score"), [F.desc("score"), "ord"], "place")


@query("rank_max", f"WITH {EXPANDED}, {_MAX} SELECT request_id, id, rank, round(final, 6) AS final FROM ranked WHERE rank <= {TOP}")
def rank_max(spark, d):
    return evaluate.rank_max(fused(spark, d), TOP).select("request_id", "id", F.col("rank").cast("long").alias("rank"), F.round("final", 6).alias("final"))


@query(
    "rank_rrf",
    f"""WITH {EXPANDED}, places AS (
      SELECT f.request_id, f.id, row_number() OVER (PARTITION BY f.request_id ORDER BY f.score DESC, f.ord) - 1 AS a,
             CASE WHEN c.id IS NOT NULL THEN row_number() OVER (PARTITION BY f.request_id ORDER BY c.graph_score DESC NULLS LAST, c.first) - 1 END AS b
      FROM fused f LEFT JOIN contrib c ON c.request_id = f.request_id AND c.id = f.id),
    r AS (SELECT *, 1 / ({evaluate.RRF_K} + a) + coalesce(1 / ({evaluate.RRF_K} + b), 0) AS rrf FROM places)
    SELECT request_id, id, round(rrf, 6) AS rrf, row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, a) AS rank FROM r QUALIFY rank <= {TOP}""",
)
def rank_rrf(spark, d):
    scores = scored(T.symbols(spark, d, True), T.requests(spark, d))
    contrib = graph.contributions(graph.reached(graph.top_seeds(scores), _edges(spark, d), 1))
    return evaluate.rank_rrf(placed(scores), contrib, TOP).select("request_id", "id", F.round("rrf", 6).alias("rrf"), F.col("rank").cast("long").alias("rank"))


@query("recall_at_k", f"WITH {EXPANDED}, {_MAX}, {_EXPECTED}, {_RECALL} SELECT request_id, k, round(recall, 6) AS recall FROM recalls")
def recall_at_k(spark, d):
    rows = evaluate.recall(evaluate.rank_max(fused(spark, d), TOP), expected(spark, d))
    return rows.select("request_id", "k", F.round("recall", 6).alias("recall"))


#: Hops, and how the graph's scores are taken in: the configurations of an evaluation, each with one field and with two.
CONFIGS = [(0, "bm25"), *((h, "max") for h in (1, 2, 3)), *((h, "rrf") for h in (1, 2, 3))]
KS = (20, 50)


def grid_sql(fielded: bool, expected: str = _EXPECTED) -> str:
    ranks = ["SELECT 'bm25' AS fusion, 0 AS hops, request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) AS rank FROM bm25"]
    more = []
    for h in (1, 2, 3):
        more.append(f"""c{h} AS (SELECT request_id, node AS id, max(score) AS g, min(seed_rank * 1000000000000 + hop::BIGINT * 1000000000 + pos) AS first FROM reached WHERE hop <= {h} GROUP BY ALL),
j{h} AS (SELECT b.request_id, b.id, b.ord, b.score, c.g, c.first FROM bm25 b LEFT JOIN c{h} c ON c.request_id = b.request_id AND c.id = b.id),
p{h} AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) - 1 AS a,
         CASE WHEN g IS NOT NULL THEN row_number() OVER (PARTITION BY request_id ORDER BY g DESC NULLS LAST, first) - 1 END AS b FROM j{h})""")
        ranks.append(f"SELECT 'max', {h}, request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY greatest(score, coalesce(g, 0)) DESC, ord) FROM j{h}")
        ranks.append(f"SELECT 'rrf', {h}, request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY 1 / ({evaluate.RRF_K} + a) + coalesce(1 / ({evaluate.RRF_K} + b), 0) DESC, a) FROM p{h}")
    ks = ", ".join(f"({k}::BIGINT)" for k in KS)
    return f"""SELECT * FROM (WITH {BASE},{bm25.scores_sql(fielded)},{EDGES},{graph.reached_sql(3)},{",".join(more)}, grid AS ({" UNION ALL ".join(ranks)}), {expected},
      found AS (SELECT c.fusion, c.hops, e.request_id, k, avg((coalesce(g.rank, 1000000000) <= k)::INT) AS recall
        FROM expected e CROSS JOIN (SELECT DISTINCT fusion, hops FROM grid) c CROSS JOIN (VALUES {ks}) v(k)
        LEFT JOIN grid g ON g.fusion = c.fusion AND g.hops = c.hops AND g.request_id = e.request_id AND g.id = e.id GROUP BY ALL)
      SELECT {str(fielded).lower()} AS fielded, f.fusion, f.hops::BIGINT AS hops, a.repo, f.k, count(*) AS tasks, round(avg(f.recall), 6) AS recall FROM found f JOIN asked a ON a.request_id = f.request_id GROUP BY ALL)"""


@query("recall_grid", " UNION ALL ".join(map(grid_sql, (False, True))))
def recall_grid(spark, d):
    return grid(spark, d, T.requests(spark, d), expected(spark, d))


def grid(spark, d, requests, expected):
    """Mean recall by repo for one and for two fields, each without the graph, with one to three hops by the greater score, and with one to three by fused ranks. Scores and expansion are computed once for each number of fields."""
    want, rows = materialize(expected, "expected"), None
    for fielded in (False, True):
        scores = scored(T.symbols(spark, d, True), requests, fielded)
        found = materialize(graph.reached(graph.top_seeds(scores), _edges(spark, d), 3), "reached")
        ranked, by_score = None, placed(scores)
        for hops, fusion in CONFIGS:
            contrib = graph.contributions(found.where(F.col("hop") <= hops))
            own = (evaluate.rank_rrf(by_score, contrib, max(KS)) if fusion == "rrf" else evaluate.rank_max(fuse(scores, contrib), max(KS))).select(F.lit(fusion).alias("fusion"), F.lit(hops).cast("long").alias("hops"), "request_id", "id", "rank")
            ranked = own if ranked is None else ranked.unionByName(own)
        configs = spark.createDataFrame([(f, h) for h, f in CONFIGS], "fusion string, hops long")
        asked = want.crossJoin(F.broadcast(configs))  # 7 rows
        recalls = evaluate.recall(ranked, asked, KS, rankings=("fusion", "hops")).join(requests.select("request_id", "repo"), "request_id")
        own = recalls.groupBy("fusion", "hops", "repo", "k").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("recall"), 6).alias("recall")).withColumn("fielded", F.lit(fielded))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query(
    "recall_macro",
    f"""WITH {EXPANDED}, {_MAX}, {_EXPECTED}, {_RECALL}, t AS (SELECT k, a.repo, recall FROM recalls r JOIN asked a ON a.request_id = r.request_id),
    repos AS (SELECT k, repo, avg(recall) AS recall FROM t GROUP BY k, repo)
    SELECT k, repo, round(recall, 6) AS recall FROM repos UNION ALL SELECT k, 'mean of repos', round(avg(recall), 6) FROM repos GROUP BY k UNION ALL SELECT k, 'mean of tasks', round(avg(recall), 6) FROM t GROUP BY k""",
)
def recall_macro(spark, d):
    rows = evaluate.macro(evaluate.recall(evaluate.rank_max(fused(spark, d), TOP), expected(spark, d)), T.requests(spark, d))
    return rows.select("k", "repo", F.round("recall", 6).alias("recall"))


@query(
    "recall_by_kind",
    f"""WITH {EXPANDED}, {_MAX}, {_EXPECTED}, r AS (SELECT e.request_id, e.kind, k, avg((coalesce(r.rank, 1000000000) <= k)::INT) AS recall
      FROM expected e LEFT JOIN ranked r ON r.request_id = e.request_id AND r.id = e.id, (VALUES (20::BIGINT), (50)) v(k) GROUP BY ALL)
    SELECT kind, k, count(*) AS tasks, round(avg(recall), 6) AS recall FROM r GROUP BY kind, k""",
)
def recall_by_kind(spark, d):
    rows = evaluate.recall(evaluate.rank_max(fused(spark, d), TOP), expected(spark, d), by=("kind",))
    return rows.groupBy("kind", "k").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.avg("recall"), 6).alias("recall"))


_FILL_ALL = packer.FILL_SQL.replace(f"floor(budget * {packer.RESERVE})::BIGINT", "budget")


@query(
    "recall_at_budget_full",
    f"""WITH RECURSIVE {EXPANDED}, {_EXPECTED} , {_FILL_ALL.replace("FROM fused f LEFT JOIN (SELECT request_id, id, min(place) AS place FROM pins GROUP BY ALL)", "FROM (SELECT * REPLACE (final + 1 AS final) FROM fused) f LEFT JOIN (SELECT request_id, id, place FROM pins WHERE false)").replace("FROM evicts e WHERE", "FROM evicts e WHERE false AND")}
    SELECT a.repo, round(count(s.id)::DOUBLE / count(*), 6) AS recall FROM expected e JOIN asked a ON a.request_id = e.request_id
    LEFT JOIN selected s ON s.request_id = e.request_id AND s.id = e.id AND s.tier = 'full' GROUP BY a.repo""",
)
def recall_at_budget_full(spark, d):
    """Of all expected ids of a repo, the share that a fill of the whole ranking, without pins and reserve, has at full detail."""
    rows = fused(spark, d).withColumn("final", F.col("final") + 1).withColumn("pin", F.lit(None).cast("int"))
    requests = T.requests(spark, d)
    full = packer.fill(rows, requests, reserve=1.0).where("tier = 'full'").select("request_id", "id", F.lit(1).alias("hit"))
    hits = expected(spark, d).join(full, ["request_id", "id"], "left").join(requests.select("request_id", "repo"), "request_id")
    return hits.groupBy("repo").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
