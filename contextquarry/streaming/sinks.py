"""Where streams end: events of turns, replays of good ones, and what they cost."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contextquarry.operators.serve import RATES, SERVING

EVENT = "turn_id long, seq long, type string, payload string"


def _projection(prompt: Column, output: Column) -> Column:
    """What the usage costs at each rate."""
    usd = lambda tokens, rate: tokens * F.lit(rate) / 1e6
    one = lambda model, a, b: F.struct(F.lit(model).alias("model"), usd(prompt, a).alias("inputUsd"), usd(output, b).alias("outputUsd"), (usd(prompt, a) + usd(output, b)).alias("totalUsd"), F.lit(model == SERVING).alias("served"))
    return F.array(*(one(*r) for r in RATES))


def events(rows: DataFrame) -> DataFrame:
    """Rows of turns.frame_stream or serve.turn_frames as the events that a client gets: turn_id, seq, type, payload (JSON). Row by row, so it holds for streams.

    Types: status, delta (frames with a text), done (usage, projection and output tokens), cancelled, and error for every other end.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    output = zero("candidates") + zero("thoughts")
    usage = F.struct(*(zero(c).alias(f"{c}TokenCount") for c in ("prompt", "candidates", "thoughts", "total")))
    state = F.col("state")
    kind = F.when(state.isNull(), "delta").when(state == "live", "status").when(state.isin("done", "cancelled"), state).otherwise("error")
    of = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("type"), *fields))
    payload = (
        F.when(kind == "status", of("status", F.lit(True).alias("live")))
        .when(kind == "delta", of("delta", F.col("text")))
        .when(kind == "done", of("done", usage.alias("usage"), _projection(zero("prompt"), output).alias("projection"), output.alias("outputTokens")))
        .when(kind == "cancelled", of("cancelled"))
        .otherwise(of("error", state.alias("error")))
    )
    told = rows.where("state IS NOT NULL OR text <> ''")
    return told.select("turn_id", (F.col("frame_no") + 1).alias("seq"), kind.alias("type"), payload.alias("payload"))


def write_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events below path, each once, however often a batch is run. Stop it by the query's stop().

    Each batch is a folder of its own, named by the checkpoint and the batch, so that one run again replaces itself; a row in the log of commits, written last, says that it is whole. read_events
    goes by the log: what a batch that failed has left behind isn't read.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(rows: DataFrame, batch: int) -> None:
        place = f"run={run}/batch={batch}"
        rows.write.mode("overwrite").parquet(f"{path}/events/{place}")
        written = rows.sparkSession.read.schema(EVENT).parquet(f"{path}/events/{place}")
        written.agg(F.count(F.lit(1)).alias("events")).write.mode("overwrite").parquet(f"{path}/commits/{place}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """turn_id, seq, type, payload: the events of batches that are committed."""
    place = "run string, batch long"
    whole = spark.read.schema(f"events long, {place}").parquet(f"{path}/commits").select("run", "batch")
    return spark.read.schema(f"{EVENT}, {place}").parquet(f"{path}/events").join(whole, ["run", "batch"], "left_semi").select("turn_id", "seq", "type", "payload")


def append_replays(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of finished turns (repo, task, ts, text, state) to the log of replays: good ones with a text only. Stop it by the query's stop()."""
    good = turns.where("state = 'done' AND text <> ''").select("repo", "task", "ts", "text")
    return good.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def record_spend(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the cents of each batch of turns (usd) as one row (batch, cents). A batch that is run again replaces its own row, so nothing is counted twice."""

    def write(rows: DataFrame, batch: int) -> None:
        cents = rows.agg(F.coalesce(F.sum(F.round(F.col("usd") * 100)), F.lit(0)).cast("long").alias("cents"))
        cents.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return turns.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
