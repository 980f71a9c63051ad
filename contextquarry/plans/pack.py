"""From requests to packs: rank, expand, fuse, fill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextquarry.functions.text import render
from contextquarry.operators import bm25, graph, packer
from contextquarry.scratch import materialize


@dataclass
class Pack:
    """The parts of an answer: selected, evicted and totals, and the scored candidates they come from."""

    selected: DataFrame
    evicted: DataFrame
    totals: DataFrame
    candidates: DataFrame


def fuse(scores: DataFrame, contrib: DataFrame) -> DataFrame:
    """Add final (the greater of both scores) and reason (graph only if it is strictly greater)."""
    joined = scores.join(contrib, ["request_id", "id"], "left")
    reason = F.when(F.col("graph_score") > F.col("score"), F.concat(F.lit("graph:"), F.col("hops").cast("string"), F.lit(" from "), F.col("from_id"))).otherwise("bm25")
    return joined.withColumn("final", F.greatest("score", F.coalesce("graph_score", F.lit(0.0)))).withColumn("reason", reason)


FUSE_SQL = """
fused AS (
  SELECT b.request_id, b.repo, b.ord, b.id, b.score, greatest(b.score, coalesce(c.graph_score, 0)) AS final,
         CASE WHEN c.graph_score > b.score THEN 'graph:' || c.hops || ' from ' || c.from_id ELSE 'bm25' END AS reason, s.c_sig, s.c_skel, s.c_full, s.kind, s.file, c.first
  FROM bm25 b JOIN symbols s ON s.repo = b.repo AND s.id = b.id LEFT JOIN contrib c ON c.request_id = b.request_id AND c.id = b.id)"""


def scored(symbols: DataFrame, requests: DataFrame, fielded: bool = True) -> DataFrame:
    """BM25 of every symbol for the requests of its repo. Requests, a short list by nature, are read by the driver: their terms become literals."""
    asked = {r["request_id"]: (r["repo"], r["task"]) for r in requests.select("request_id", "repo", "task").collect()}
    tasks, repos = {k: t or "" for k, (_, t) in asked.items()}, {k: r for k, (r, _) in asked.items()}
    return materialize(bm25.scores(symbols, tasks, fielded, keep=("repo", "ord", "id", "tokens"), repos=repos), "scores")


def pack(symbols: DataFrame, edges: DataFrame, requests: DataFrame, hops: int = 1, seeds: int = graph.SEEDS, first_edge: bool = True) -> Pack:
    requests = materialize(requests, "requests")  # a short list, but what its pins and evicts name may have to be found
    scores = scored(symbols, requests)
    contrib = graph.contributions(graph.reached(graph.top_seeds(scores, seeds), edges, hops, first_edge))
    rows = materialize(packer.candidates(fuse(scores, contrib).drop("first"), requests), "candidates")
    selected = packer.fill(rows, requests)
    return Pack(selected, packer.evicted(rows, selected), packer.totals(selected, rows, requests), rows)


def render_pack(selected: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and text: the selected symbols, rendered at their tiers, in order. A budget bounds what is collected for a request."""
    parts = ("signature", "doc_first", "doc_rest", "body")
    texts = symbols.select("repo", "id", *parts)
    rows = selected.join(requests.select("request_id", "repo"), "request_id").join(texts, ["repo", "id"])
    cols = list(map(F.col, parts))
    text = F.when(F.col("tier") == "full", render("full", *cols)).when(F.col("tier") == "skeleton", render("skeleton", *cols)).otherwise(render("signature", *cols))
    rows = rows.select("request_id", F.struct("pos", text.alias("text")).alias("x"))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "").alias("text"))
