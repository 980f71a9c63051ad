"""Greedy filling of a token budget at three levels of detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.functions.text import TIERS
from contextquarry.scratch import materialize

#: Fixed value: the part of a budget that is filled.
RESERVE = 0.995
#: Candidates that one fold takes for a request. More are folded in further rounds, so no group grows with the corpus. Up to this number Spark
#: keeps a rank's limit in the tasks before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold), so only the best of each task meet.
ROUND = 1000
PLACED = "array<struct<id:string,tier:string,tokens:long,reason:string>>"


def effective_budget(budget: Column, reserve: float = RESERVE) -> Column:
    return F.floor(budget * reserve).cast("long")


def candidates(fused: DataFrame, requests: DataFrame) -> DataFrame:
    """fused (request_id, id, ord, tokens, final, reason) with pin (place among the pins, or null), without what the request evicts. A pin is stronger than an evict."""
    pins = requests.select("request_id", F.posexplode(F.array_distinct("pins")).alias("pin", "id"))
    evicts = requests.select("request_id", F.explode("evicts").alias("id")).distinct()
    evicts = evicts.join(pins.select("request_id", "id"), ["request_id", "id"], "left_anti")
    return fused.join(evicts, ["request_id", "id"], "left_anti").join(pins, ["request_id", "id"], "left")


def fill(rows: DataFrame, requests: DataFrame, per_round: int = ROUND, reserve: float = RESERVE) -> DataFrame:
    """request_id, pos, id, tier, tokens, reason of what is selected. Rows are read once for each round, so they should be a table.

    Pins come first, in their order, at the first tier of full, skeleton, signature whose cost fits; then the positive scores, best first, ties by ord,
    at the first such tier of a positive cost. What doesn't fit is passed over. A fold over an ordered array per request; rows that can't fit any more are left
    out of later rounds, and a round takes per_round rows of each request.
    """
    is_pin = F.col("pin").isNotNull()
    key = F.struct((~is_pin).alias("late"), F.coalesce("pin", F.lit(0)).alias("pin"), F.when(is_pin, 0.0).otherwise(-F.col("final")).alias("rank"), "ord")
    least = reduce(F.least, (F.when(F.col(f"tokens.{t}") > 0, F.col(f"tokens.{t}")) for t in TIERS))
    open_rows = rows.where(is_pin | (F.col("final") > 0)).select("request_id", "id", "tokens", "reason", key.alias("key"), least.alias("least"))
    state = requests.select("request_id", effective_budget(F.col("budget"), reserve).alias("remaining"), F.lit(0).alias("placed"))
    cut, selected = None, None

    def step(acc: Column, x: Column) -> Column:
        fits = lambda t: (x["tokens"][t] <= acc["remaining"]) & (~x["key"]["late"] | (x["tokens"][t] > 0))
        tier = F.when(fits("full"), "full").when(fits("skeleton"), "skeleton").when(fits("signature"), "signature")
        cost = F.when(fits("full"), x["tokens"]["full"]).when(fits("skeleton"), x["tokens"]["skeleton"]).otherwise(x["tokens"]["signature"])
        kept = F.when(tier == "full", "kept").otherwise(F.concat(F.lit("kept (degraded to "), tier, F.lit(": full did not fit)")))
        put = F.struct(x["id"].alias("id"), tier.alias("tier"), cost.alias("tokens"), F.when(x["key"]["late"], x["reason"]).otherwise(kept).alias("reason"))
        return F.when(tier.isNotNull(), F.struct((acc["remaining"] - cost).alias("remaining"), F.concat(acc["out"], F.array(put)).alias("out"))).otherwise(acc)

    while True:
        eligible = open_rows.join(state.withColumnRenamed("request_id", "_r"), F.col("request_id") == F.col("_r")).where(~F.col("key.late") | (F.col("least") <= F.col("remaining")))
        if cut is not None:
            eligible = eligible.join(cut.withColumnRenamed("request_id", "_q"), F.col("request_id") == F.col("_q")).where(F.col("key") > F.col("last"))
        ranked = eligible.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("key"))).where(F.col("_n") <= per_round)
        item = F.struct("key", "id", "tokens", "reason")
        start = F.struct(F.col("remaining").alias("remaining"), F.array().cast(PLACED).alias("out"))
        folded = ranked.groupBy("request_id", "remaining", "placed").agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = folded.select("request_id", "placed", F.aggregate("items", start, step).alias("f"), F.size("items").alias("n"), F.element_at("items", -1)["key"].alias("last"))
        folded = materialize(folded, "pack-round")
        out = folded.select("request_id", F.posexplode("f.out").alias("at", "x"), "placed").select("request_id", (F.col("placed") + F.col("at")).cast("long").alias("pos"), "x.*")
        selected = out if selected is None else selected.unionByName(out)
        if not folded.where(F.col("n") >= per_round).take(1):
            return selected
        state = folded.where(F.col("n") >= per_round).select("request_id", F.col("f.remaining").alias("remaining"), (F.col("placed") + F.size("f.out")).alias("placed"))
        cut = folded.select("request_id", "last")


def evicted(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """request_id, id, tokens, reason of all candidates that are not selected."""
    left = rows.join(selected.select("request_id", "id"), ["request_id", "id"], "left_anti")
    pin = F.col("pin").isNotNull()
    none = ~pin & (F.col("final") <= 0)
    reason = F.when(pin, "kept, but no budget left").when(none, "no match for this task").otherwise("ran out of budget")
    return left.select("request_id", "id", F.when(none, F.lit(0).cast("long")).otherwise(F.col("tokens.signature")).alias("tokens"), reason.alias("reason"))


def totals(selected: DataFrame, rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: what signatures, documentation and bodies take, all tokens, and the effective budget. Requests without a selection have zeros."""
    costs = selected.join(rows.select("request_id", "id", F.col("tokens").alias("c")), ["request_id", "id"])
    above = lambda a, b: F.greatest(F.lit(0), F.col(f"c.{a}") - F.col(f"c.{b}"))
    sums = costs.groupBy("request_id").agg(
        F.sum("c.signature").alias("signature"),
        F.sum(F.when(F.col("tier").isin("skeleton", "full"), above("skeleton", "signature")).otherwise(0)).alias("doc"),
        F.sum(F.when(F.col("tier") == "full", above("full", "skeleton")).otherwise(0)).alias("body"),
        F.sum("tokens").alias("total"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return requests.join(sums, "request_id", "left").select("request_id", *map(zero, ("signature", "doc", "body", "total")), effective_budget(F.col("budget")).alias("budget"))


#: CTEs cand and step from fused (request_id, id, ord, final, reason, c_sig, c_skel, c_full), pins, evicts and asked.
FILL_SQL = f"""
cand0 AS (
  SELECT f.*, p.place AS pin FROM fused f LEFT JOIN (SELECT request_id, id, min(place) AS place FROM pins GROUP BY ALL) p ON p.request_id = f.request_id AND p.id = f.id
  WHERE p.place IS NOT NULL OR NOT EXISTS (SELECT 1 FROM evicts e WHERE e.request_id = f.request_id AND e.id = f.id)),
cand AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pin IS NULL, pin, final DESC, ord) AS rn FROM cand0 WHERE pin IS NOT NULL OR final > 0),
step(request_id, rn, id, tier, cost, rem) AS (
  SELECT request_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, floor(budget * {RESERVE})::BIGINT FROM asked
  UNION ALL
  SELECT request_id, rn, id, tier, CASE tier WHEN 'full' THEN c_full WHEN 'skeleton' THEN c_skel WHEN 'signature' THEN c_sig ELSE 0 END,
         rem - CASE tier WHEN 'full' THEN c_full WHEN 'skeleton' THEN c_skel WHEN 'signature' THEN c_sig ELSE 0 END
  FROM (SELECT c.request_id, c.rn, c.id, p.rem, c.c_sig, c.c_skel, c.c_full,
               CASE WHEN (pin IS NOT NULL OR c_full > 0) AND c_full <= rem THEN 'full' WHEN (pin IS NOT NULL OR c_skel > 0) AND c_skel <= rem THEN 'skeleton'
                    WHEN (pin IS NOT NULL OR c_sig > 0) AND c_sig <= rem THEN 'signature' END AS tier
        FROM step p JOIN cand c ON c.request_id = p.request_id AND c.rn = p.rn + 1)),
selected AS (
  SELECT s.request_id, row_number() OVER (PARTITION BY s.request_id ORDER BY s.rn) - 1 AS pos, s.id, s.tier, s.cost AS tokens,
         CASE WHEN c.pin IS NULL THEN c.reason WHEN s.tier = 'full' THEN 'kept' ELSE 'kept (degraded to ' || s.tier || ': full did not fit)' END AS reason
  FROM step s JOIN cand c ON c.request_id = s.request_id AND c.rn = s.rn WHERE s.tier IS NOT NULL),
evicted AS (
  SELECT c.request_id, c.id, CASE WHEN c.pin IS NULL AND c.final <= 0 THEN 0 ELSE c.c_sig END AS tokens,
         CASE WHEN c.pin IS NOT NULL THEN 'kept, but no budget left' WHEN c.final <= 0 THEN 'no match for this task' ELSE 'ran out of budget' END AS reason
  FROM cand0 c WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.request_id = c.request_id AND s.id = c.id))"""
