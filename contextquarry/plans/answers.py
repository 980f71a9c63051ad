"""Packs as JSON documents: an answer for each request, and what it leaves out in numbered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.plans.pack import Pack

#: Rows of a part of the evicted list, on average.
PART_ROWS = 1000
#: The names of an answer's fields.
ITEMS = "array<struct<id:string,tier:string,tokens:bigint,reason:string>>"
ANSWER = f"selected {ITEMS}, totals struct<signature:bigint,doc:bigint,body:bigint,total:bigint>, budget bigint, tokenSource string, evictedParts bigint"
EVICTED = "part bigint, evicted array<struct<id:string,tokens:bigint,reason:string>>"


def _listed(items: Column, *fields: str) -> Column:
    """Items in order, with these fields."""
    return F.transform(F.array_sort(F.collect_list(items)), lambda x: F.struct(*(x[f].alias(f) for f in fields)))


def answers(packed: Pack, requests: DataFrame, token_source: str = "estimate", part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Answers (request_id, document) and what they leave out (request_id, part, document), as JSON.

    A budget bounds what is selected, so it is one list. What is evicted grows with the corpus: it is dealt to parts by the hash of the id, about part_rows in
    each and in the order of ids, and the answer says how many parts there are. So no row grows with the corpus, and parts can be read one by one.
    """
    kept = packed.selected.groupBy("request_id").agg(_listed(F.struct("pos", "id", "tier", "tokens", "reason"), "id", "tier", "tokens", "reason").alias("selected"))
    counts = packed.evicted.groupBy("request_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("long").alias("parts"))
    rows = packed.evicted.join(counts, "request_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    parts = rows.groupBy("request_id", "part").agg(_listed(F.struct("id", "tokens", "reason"), "id", "tokens", "reason").alias("evicted"))
    parts = parts.select("request_id", "part", F.to_json(F.struct("part", "evicted")).alias("document"))
    # parts that the hash has left empty aren't there
    numbers = parts.groupBy("request_id").agg(F.count(F.lit(1)).alias("evictedParts"))
    every = packed.totals.join(kept, "request_id", "left").join(numbers, "request_id", "left").join(requests.select("request_id"), "request_id")
    none = F.array().cast(ITEMS)
    answer = F.struct(
        F.coalesce("selected", none).alias("selected"), F.struct("signature", "doc", "body", "total").alias("totals"), F.col("budget"), F.lit(token_source).alias("tokenSource"), F.coalesce("evictedParts", F.lit(0)).alias("evictedParts")
    )
    return every.select("request_id", F.to_json(answer).alias("document")), parts


def read_answers(found: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The relations that answers hold: selected (request_id, pos, id, tier, tokens, reason), evicted (request_id, id, tokens, reason) and totals."""
    a = found.select("request_id", F.from_json("document", ANSWER).alias("a"))
    selected = a.select("request_id", F.posexplode("a.selected").alias("pos", "x")).select("request_id", F.col("pos").cast("long").alias("pos"), "x.*")
    evicted = parts.select("request_id", F.explode(F.from_json("document", EVICTED)["evicted"]).alias("x")).select("request_id", "x.*")
    return selected, evicted, a.select("request_id", "a.totals.*", "a.budget")
