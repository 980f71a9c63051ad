"""Which rows of a key come after its first holder, by a range sort: no key is too large for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize

LATER, UNSURE, HEAD = 0, 1, 2


def hash_columns(value: Column) -> tuple[Column, Column]:
    """128 bits of a string as two longs."""
    digest = F.md5(value.cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def _stream(carried: list[str]):
    """The rows of one sorted partition: LATER ones, those of the first key (UNSURE, as it may have begun in another partition), and the HEADs of the first and last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, first = None, None, True  # the key that goes on, its first holder, and whether it is the partition's first key
        schema = None

        def heads(rows: list[tuple]) -> pa.RecordBatch:
            k1, k2, a, b = (pa.array([r[i] for r in rows], pa.int64()) for i in range(4))
            kinds = pa.array([HEAD] * len(rows), pa.int32())
            return pa.RecordBatch.from_arrays([kinds, k1, k2, a, b, *(pa.nulls(len(rows), schema.field(c).type) for c in carried)], names=["kind", "k1", "k2", "a", "b", *carried])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            k1, k2, a, b = (batch.column(c).to_numpy() for c in ("k1", "k2", "a", "b"))
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            goes_on = key is not None and key == (k1[0], k2[0])
            if key is None:
                key, head = (k1[0], k2[0]), (a[0], b[0])
                yield heads([(*key, *head)])
                goes_on = True
            new[0] = not goes_on
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            begun = np.logical_or.accumulate(new)  # rows of keys that began in this batch
            held_a, held_b = np.where(begun, a[start], head[0]), np.where(begun, b[start], head[1])
            later = (a != held_a) | (b != held_b)
            unsure = ~begun & first
            keep = np.flatnonzero(later | unsure)
            if len(keep):
                kind = np.where(unsure[keep], UNSURE, LATER).astype(np.int32)
                rows = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array(kind), *(rows.column(c) for c in ("k1", "k2", "a", "b", *carried))], names=["kind", "k1", "k2", "a", "b", *carried])
            if begun[-1]:
                first, at = False, start[-1]
                key, head = (k1[at], k2[at]), (a[at], b[at])
        if key is not None and not first:
            yield heads([(*key, *head)])

    return run


def later_rows(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows whose key (k1, k2) has a lesser holder (a, b) than their own; without k1, k2, a and b.

    k1, k2, a and b are longs without nulls; other columns are carried. Rows are range-partitioned and sorted by key and holder, and each partition streams past the first holder of
    each key. A key may span partitions: only the first key of a partition can have begun before, so its rows wait for the heads of keys at
    the edges, two a partition, which are broadcast.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = [c for c in rows.columns if c not in ("k1", "k2", "a", "b")]
    fields = ", ".join(["kind int", "k1 long", "k2 long", "a long", "b long", *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)])
    in_order = rows.repartitionByRange(n, "k1", "k2", "a", "b", *carried).sortWithinPartitions("k1", "k2", "a", "b")
    found = materialize(arrow_batches(in_order).mapInArrow(_stream(carried), fields), "later-rows")
    heads = found.where(F.col("kind") == HEAD).groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.min(F.struct("a", "b")).alias("_head"))
    unsure = found.where(F.col("kind") == UNSURE).join(F.broadcast(heads), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    unsure = unsure.where(F.struct("a", "b") != F.col("_head")).select(*carried)
    return found.where(F.col("kind") == LATER).select(*carried).unionByName(unsure)
