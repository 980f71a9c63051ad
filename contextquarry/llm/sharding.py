"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import materialize, running

#: A group of at least 1/LARGE of all bytes is an item of its own: there are at most LARGE of them.
LARGE = 16_384
#: Smaller groups are bundled by the hash of their text into this many items.
BUNDLES = 16_384
SLOT_ROWS = 2000


def differencing(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. Always the two partial partitions of the largest spread are combined, the larger
    sums of one with the smaller sums of the other, until one is left. Ties go by position.

    A partial partition is a tree of two earlier ones and the order in which their sums met; places are
    then handed down from the root.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int32)
    sums: list[list[int]] = [[0] * (shards - 1) + [int(s)] for s in sizes]  # ascending
    parts: list[tuple] = [()] * n  # of a combination: (a, b, the order of the new sums)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        met = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(shards), key=met.__getitem__)
        low = met[order[0]]
        sums.append([met[i] - low for i in order])
        sums[a] = sums[b] = ()
        parts.append((a, b, order))
        heapq.heappush(heap, (-sums[-1][-1], len(sums) - 1))
    places: list = [None] * len(parts)
    places[-1] = list(range(shards))
    found = np.zeros(n, np.int32)
    for k in range(len(parts) - 1, n - 1, -1):
        a, b, order = parts[k]
        at = [0] * shards
        for new, met in enumerate(order):
            at[met] = places[k][new]
        places[a], places[b], places[k] = at, at[::-1], None
    for k in range(n):
        found[k] = places[k][-1]
    return found


def _bundle() -> Column:
    return F.concat(F.lit("bundle "), F.pmod("_h", F.lit(BUNDLES)).cast("string"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows of equal text are one indivisible group; null texts are a group, too (size 1 each). A size is the text's UTF-8
    bytes plus 1. Groups with at least 1/LARGE of all bytes are items, and by that at most LARGE; all others
    are bundled by their hash into BUNDLES items, each a small part of a shard. So one task differences a set of at most
    LARGE + BUNDLES sizes, whatever the input. Slots number a shard's rows from 0 in the order of (hash of doc_id and text,
    doc_id, hash of text), by distributed prefix sums. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null")).alias("_group"),
        F.xxhash64(F.lit("bundle"), F.col("text")).alias("_h"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_size"), F.first("_h").alias("_h"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = max(1, -(-total // LARGE))
    item = F.when(F.col("_size") >= least, F.col("_group")).otherwise(_bundle())
    groups = materialize(groups.select("_group", "_size", item.alias("_item")), "shard-groups")
    items = groups.groupBy("_item").agg(F.sum("_size").alias("_size"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_item"], ascending=[False, True])
        return pd.DataFrame({"_item": pdf["_item"], "shard": differencing(pdf["_size"].to_numpy(), shards)})

    # at most LARGE + BUNDLES rows
    placed = materialize(items.groupBy().applyInPandas(solve, "_item string, shard int"), "shard-items")
    large = placed.where("_item NOT LIKE 'bundle %'").select(F.col("_item").alias("_group"), F.col("shard").alias("_own"))
    bundles = placed.where("_item LIKE 'bundle %'").withColumnRenamed("shard", "_bundle")
    buckets = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    # rows find their items where they lie, so one text's rows don't meet in a task
    put = rows.join(F.broadcast(large), "_group", "left").withColumn("_item", _bundle()).join(F.broadcast(bundles), "_item", "left")
    put = put.withColumn("shard", F.coalesce("_own", "_bundle")).drop("_own", "_bundle", "_item").withColumn("_key", F.xxhash64("doc_id", "_h"))
    put = put.withColumn("_bucket", F.floor((F.shiftright("_key", 32) + F.lit(1 << 31)) * buckets / F.lit(float(1 << 32))).cast("long"))
    put = running(put, ["shard"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("_h")], {"slot": F.lit(1)})
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
