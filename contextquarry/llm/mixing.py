"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.llm.common import hash_bucket, materialize, n_words, running

#: Rows of a bucket of hash keys, on average.
BUCKET_ROWS = 2000


def cycled_weights(cycle: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights of the cycle dealt to the sources in the order of their names, null last. For a column _rank from 0."""
    return F.element_at(F.array(*(F.lit(int(w)) for w in cycle)), (F.col("_rank") % len(cycle) + 1).cast("int")).cast("long")


def targets(totals: DataFrame, max_epochs: int = 3, weight: Column | None = None) -> DataFrame:
    """totals (source, source_size) -> source, source_size, weight, target.

    The targets share the sum of all sizes by weight. None exceeds max_epochs times its source's size; what is
    above is shared again among the rest by weight. In the order of max_epochs * size / weight, the sources that stop at
    their limit come first, so one pass over running sums finds the share of the others. One row per source, and all of them in one task: sources may
    be some hundred thousand, no more.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = totals.withColumn("_rank", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn("weight", weight if weight is not None else cycled_weights()).withColumn("_limit", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("_limit") / F.col("weight"), "_rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    shared = weighed.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("weight").over(rest)).alias("_level"),
    ).withColumn("_stops", F.col("_limit") <= F.col("_level") * F.col("weight"))
    # the level of the first source that doesn't stop holds for all after it
    level = F.min(F.when(~F.col("_stops"), F.struct(F.col("_limit") / F.col("weight"), F.col("_rank"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_stops"), F.col("_limit").cast("double")).otherwise(level["level"] * F.col("weight"))
    return shared.select("source", "source_size", "weight", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, weight: Column | None = None, whole_documents: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    Each document gets a key, the MD5 of seed, doc_id and the MD5 of its text. Within a source, documents are ordered by key; prefix
    sums of their sizes in words are made by ranges of keys, so a source of any size spreads over many tasks. A source is
    taken whole as often as its budget (the target's whole part) allows, and then up to the exact budget: the document at
    the cut is taken in part, or with whole_documents, if at least half of it fits. So taken <= max_epochs * size.

    Null texts are empty, of size 0, and never taken. A null source is a source of its own, last in order. Repeated rows have equal keys. A source without words has target 0. An empty table gives no rows.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("_key"),
        F.xxhash64("text").alias("_tie"),
    )
    sized = materialize(sized, "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    aims = targets(totals.drop("_rows"), max_epochs, weight).join(totals.select(F.col("source").alias("_src"), "_rows"), F.col("source").eqNullSafe(F.col("_src")))
    aims = aims.select(F.col("source").alias("_s"), "source_size", "target", F.ceil(F.col("_rows") / BUCKET_ROWS).alias("_buckets"))
    rows = sized.join(aims, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_bucket", hash_bucket(F.col("_key"), F.col("_buckets")))
    ranked = running(rows, ["source"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("_tie"), F.col("size")], {"_before": F.col("size")})
    budget = F.floor("target").cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    left = budget - turns * F.col("source_size") - F.col("_before")
    part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole_documents else F.least(left, F.col("size"))
    taken = turns * F.col("size") + F.greatest(part, F.lit(0))
    return ranked.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "_tie")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, whole, each as often as it is taken; same columns as docs.

    Null, empty and blank texts have no words and are never taken. Repeated rows are taken as often as each other. Null sources are one source; an empty table gives no rows.
    """
    chosen = mix(docs, whole_documents=True, **options).where("taken > 0")
    # repeated rows of one document and text get the same number of turns each: one row of the choice is enough
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    turns = chosen.groupBy(F.col("doc_id").alias("__cq_id"), F.col("_tie").alias("__cq_tie")).agg(F.max(times).alias("__cq_turns"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__cq_id")) & (F.xxhash64("text") == F.col("__cq_tie"))
    return docs.hint("merge").join(turns, same).withColumn("__cq_turn", F.explode(F.sequence(F.lit(1), F.col("__cq_turns")))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM totals),
weighed AS (SELECT *, (r % 3 + 1)::BIGINT AS w, source_size * 3 AS lim FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY lim / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
stops AS (SELECT *, lim <= level * w AS stops FROM levels),
aims AS (
  SELECT source, source_size, round(CASE WHEN stops THEN lim::DOUBLE ELSE w * first_value(level) OVER (ORDER BY stops, lim / w, r) END, 6) AS target
  FROM stops),
run AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
             + greatest(0, least(size, budget - budget // source_size * source_size - before)) END)::BIGINT AS taken
FROM run
"""
