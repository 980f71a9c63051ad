"""Retrieval evaluation: ranks under several configurations, and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.scratch import materialize

RRF_K = 60


def rank_max(fused: DataFrame, limit: int | None = None) -> DataFrame:
    """Add rank (from 1) by final, ties by ord. fused: request_id, id, ord, score, final. With a limit only the first ranks, of which tasks send no more to the shuffle."""
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("final"), "ord")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def places(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add name: the place of each row in its request's list by order, from 0. The rows are written.

    A range sort numbers the rows of each task; what a request has in the tasks before is a sum over a row for each task. So no task has a request's whole list.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["request_id", *order]
    numbered = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33))
    numbered = materialize(numbered, f"places{name}")
    tasks = numbered.groupBy("request_id", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("request_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("request_id", "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return numbered.join(offsets, ["request_id", "_task"]).withColumn(name, F.col("_at") + F.col("_offset")).drop("_at", "_task", "_offset")


def prefix(limit: int) -> int:
    """So many of both lists have all of the first `limit` fused ranks: the first ones by score have 1 / (RRF_K + limit - 1) at least, and whoever is in neither prefix has no more from both lists together."""
    return RRF_K + 2 * limit - 2


def rank_rrf(scored: DataFrame, contrib: DataFrame, limit: int) -> DataFrame:
    """request_id, id, ord, rrf, rank: the first `limit` by the sum of 1 / (RRF_K + place) over the list by score and the list by graph_score (places from 0, ties by ord and by first reach); ties by the first list.

    scored: request_id, id, ord and place (in the list by score, see places). contrib: request_id, id, graph_score, first. Only rows that are in the prefix of either list are ranked.
    """
    reached = places(contrib.select("request_id", "id", "graph_score", "first"), [F.desc("graph_score"), "first"], "_b").select("request_id", "id", "_b")
    rows = scored.select("request_id", "id", "ord", "place").join(reached, ["request_id", "id"], "left")
    near = rows.where((F.col("place") < prefix(limit)) | (F.col("_b") < prefix(limit)))
    near = near.withColumn("rrf", 1 / (RRF_K + F.col("place")) + F.coalesce(1 / (RRF_K + F.col("_b")), F.lit(0.0)))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("rrf"), "place")))
    return ranked.where(F.col("rank") <= limit).drop("place", "_b")


def recall(ranked: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (20, 50), by: tuple[str, ...] = (), rankings: tuple[str, ...] = ()) -> DataFrame:
    """request_id, the columns of by, k, recall: the share of expected (request_id, id, by) among the first k. rankings: columns of both that tell several rankings apart."""
    by = (*rankings, *by)
    rows = expected.join(ranked.select("request_id", "id", "rank", *rankings), ["request_id", "id", *rankings], "left")
    hits = [F.struct(F.lit(k).cast("long").alias("k"), (F.coalesce(F.col("rank"), F.lit(1 << 30)) <= k).cast("long").alias("hit")) for k in ks]
    flat = rows.select("request_id", *by, F.explode(F.array(*hits)).alias("h"))
    return flat.groupBy("request_id", *by, F.col("h.k").alias("k")).agg((F.sum("h.hit") / F.count(F.lit(1))).alias("recall"))


def macro(recalls: DataFrame, requests: DataFrame) -> DataFrame:
    """k, repo, recall: means over the requests of a repo; repo null is the mean of those means, 'tasks' the mean over all requests."""
    rows = recalls.join(requests.select("request_id", "repo"), "request_id")
    repos = rows.groupBy("k", "repo").agg(F.avg("recall").alias("recall"))
    whole = repos.groupBy("k").agg(F.avg("recall").alias("recall")).select("k", F.lit("mean of repos").alias("repo"), "recall")
    tasks = rows.groupBy("k").agg(F.avg("recall").alias("recall")).select("k", F.lit("mean of tasks").alias("repo"), "recall")
    return repos.unionByName(whole).unionByName(tasks)
