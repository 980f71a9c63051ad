"""What several corpus operators share: words, Arrow batches, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.scratch import materialize

__all__ = ["SPACES", "WORD", "arrow_batches", "hash_bucket", "materialize", "n_words", "running"]

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch, at most; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 4000, 4 << 20


def arrow_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small, whatever the length of texts. Both settings are the same for all operators, as Spark reads them when a job starts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def n_words(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bucket(hexkey: Column, buckets: int | Column) -> Column:
    """Which of equal ranges of the key space a key of lowercase hexadecimal digits falls into. Buckets keep the order of keys."""
    at = F.conv(F.substring(hexkey, 1, 8), 16, 10).cast("long")
    return F.floor(at * buckets / F.lit(float(1 << 32))).cast("long")


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], add: dict[str, Column]) -> DataFrame:
    """Exclusive prefix sums within each group, in the order of (bucket, order).

    add: name of the new column -> what is summed. Each (group, bucket) is summed first; offsets come from
    a window over those sums, and only then are rows ranked inside their own bucket. No task holds a whole
    group, if buckets are many. The group's columns may be null.
    """
    key = [*group, bucket]
    sums = df.groupBy(*key).agg(*(F.sum(c).cast("long").alias(f"_s_{n}") for n, c in add.items()))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)),
        *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in add),
    )
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in add.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    joined = ranked.join(offsets, same, "left")
    keep = [c for c in df.columns if c not in add]
    return joined.select(*keep, *((F.col(f"_o_{n}") + F.col(f"_i_{n}")).cast("long").alias(n) for n in add))
