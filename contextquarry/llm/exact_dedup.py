"""Exact deduplication by a content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize

#: Characters of the text in a splitter. Splitters stay small, whatever the length of texts.
SPLITTER_CHARS = 48
RUNS = "doc_id long, text_sha256 string, head long, n long, edge boolean, pid int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons in one sorted partition.

    A block holds the rows of equal (splitter, hash); of it only identifiers are kept, not texts. The first
    and last block may go on in another partition: they are marked as edges.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    names = ["doc_id", "text_sha256", "head", "n", "edge", "pid"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()]
    block, key, text, first, out = [], None, None, True, [[] for _ in names]

    def close(edge: bool) -> None:
        for ids, sha in block:
            head = max((i for i in ids if i is not None), default=None)
            for col, v in zip(out, (ids, [sha] * len(ids), [head] * len(ids), [len(ids)] * len(ids), [edge] * len(ids), [pid] * len(ids)), strict=True):
                col.extend(v)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        keys = zip(batch.column("_p").to_pylist(), batch.column("_h").to_pylist(), strict=True)
        for i, (k, body, doc_id) in enumerate(zip(keys, batch.column("_t"), batch.column("doc_id").to_pylist(), strict=True)):
            body = body.as_buffer()
            if k != key:
                if block:
                    close(first)
                    first = False
                block, key, text = [], k, None
            if text is None or not text.equals(body):
                block.append(([], hashlib.sha256(body).hexdigest()))
                text = pa.py_buffer(body.to_pybytes())
            block[-1][0].append(doc_id)
        if len(out[0]) >= 20_000:
            yield flush()
    if block:
        close(True)
    if out[0]:
        yield flush()


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Sampled splitters range-partition the rows by (start of the text, hash, doc_id), so equal texts are
    neighbours and a group of any size spreads over as many partitions as it needs; the external sort of each
    partition places equals adjacent, and neighbours are compared in full. Runs that touch the edge of a
    partition are joined by their SHA-256 with those of other partitions: at most a few per partition.

    normalise: what is done to a text before (default: nothing). Null is the empty text. Of equal texts the
    row with the largest doc_id stays; of repeated rows with that doc_id one row is as good as another, and
    all of them say kept. A null doc_id is less than any other; a group of such rows only has keep_id null and
    keeps them. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    text = normalise(text) if normalise else text
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    keyed = keyed.select("doc_id", F.substring("_t", 1, SPLITTER_CHARS).alias("_p"), F.xxhash64("_t").alias("_h"), F.col("_t").cast("binary").alias("_t"))
    in_order = keyed.repartitionByRange(n, "_p", "_h", F.col("doc_id").desc()).sortWithinPartitions("_p", "_h", "_t", F.col("doc_id").desc())
    runs = materialize(arrow_batches(in_order).mapInArrow(_runs, RUNS), "content-runs")
    edges = runs.where("edge").groupBy("pid", "text_sha256").agg(F.max("head").alias("head"), F.max("n").alias("n"))
    whole = edges.groupBy("text_sha256").agg(F.max("head").alias("_head"), F.sum("n").alias("_n"))
    # two blocks a partition; rows meet them by partition and text, so a group over many partitions is no hot key
    ends = edges.select("pid", "text_sha256").join(whole, "text_sha256")
    joined = runs.where("edge").join(ends, ["pid", "text_sha256"]).select("doc_id", "text_sha256", F.col("_head").alias("head"), F.col("_n").alias("n"))
    rows = runs.where("NOT edge").select("doc_id", "text_sha256", "head", "n").unionByName(joined)
    keep, size = F.col("head"), F.col("n")
    return rows.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
