"""A ceiling on what all turns spend together, held over streams: shares of what is left are leased to tasks and settled per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contextquarry.operators.serve import CEILING_CENTS

#: Leases of a batch.
SHARES = 64


def leased(turns: DataFrame, spent: int, ceiling: int = CEILING_CENTS, shares: int = SHARES, share: Column | None = None) -> DataFrame:
    """turns (turn_id, ts, cents) with share, lease and allowed: one batch, when `spent` cents are settled.

    What is left of the ceiling is leased to `shares` shares in equal parts, and a turn has the share of its id's hash (or share); so each share's turns are judged by themselves, in the order of ts and
    turn_id: a turn is allowed while its share has spent less than its lease. As turns cost what they cost, a share may exceed its lease by its last turn, and a batch the ceiling by
    the last turns of its shares.
    """
    left = max(0, ceiling - spent)
    share = F.pmod(F.xxhash64(F.lit("share"), "turn_id"), F.lit(shares)).cast("int") if share is None else share
    rows = turns.withColumn("share", share).withColumn("lease", F.lit(left // shares) + (F.col("share") < left % shares).cast("long"))
    before = Window.partitionBy("share").orderBy("ts", "turn_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("allowed", F.coalesce(F.sum("cents").over(before), F.lit(0)) < F.col("lease"))


class Ledger:
    """Below path, a folder for each batch: what it has decided, and, written last, what it has settled. A batch that is run again replaces its own folders and finds the same leases."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        except Exception as e:  # noqa: BLE001
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def settled(self) -> DataFrame:
        """cents and batch: what each batch has spent."""
        return self._read("settled", "cents long")

    def spent(self, before: int) -> int:
        """What batches before this one have spent."""
        return self.settled().where(F.col("batch") < before).agg(F.coalesce(F.sum("cents"), F.lit(0)).cast("long")).first()[0]

    def decisions(self, schema: str = "turn_id long, ts timestamp, cents long, share int, lease long, allowed boolean") -> DataFrame:
        """What settled batches have decided."""
        return self._read("decisions", schema).join(self.settled().select("batch"), "batch", "left_semi")

    def settle(self, turns: DataFrame, batch: int, ceiling: int = CEILING_CENTS, shares: int = SHARES, share: Column | None = None) -> None:
        """Decide a batch (turn_id, ts, cents), and then say what it has spent."""
        decided = leased(turns, self.spent(batch), ceiling, shares, share)
        decided.write.mode("overwrite").parquet(f"{self.path}/decisions/batch={batch}")
        stored = self.spark.read.schema(decided.schema).parquet(f"{self.path}/decisions/batch={batch}")
        stored.where("allowed").agg(F.coalesce(F.sum("cents"), F.lit(0)).cast("long").alias("cents")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settled/batch={batch}")


def hold_ceiling(turns: DataFrame, path: str, checkpoint: str, ceiling: int = CEILING_CENTS, shares: int = SHARES, **options: str) -> StreamingQuery:
    """Decide a stream of turns (turn_id, ts, cents) batch by batch in the ledger below path; see leased. A ledger belongs to one checkpoint. Stop it by the query's stop()."""

    def write(rows: DataFrame, batch: int) -> None:
        Ledger(rows.sparkSession, path).settle(rows.select("turn_id", "ts", "cents"), batch, ceiling, shares)

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
