"""What surrounds a pack: admission of requests, recorded streams, usage, prices and quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a body, budgets, hits and seconds of a window, cents of all turns.
MAX_BODY = 65_536
BUDGETS = (4000, 8000, 16000, 32000)
LIMIT, WINDOW_SECONDS = 3, 86_400
#: Fixed value: seconds that a turn may take from one chunk to the next.
IDLE_SECONDS = 45
CEILING_CENTS = 2500
#: Dollars for a million tokens in and out.
RATES = [("large", 5.0, 25.0), ("medium", 3.0, 15.0), ("served", 0.0, 0.0)]
SERVING = "served"


def admission(bodies: DataFrame, catalog: DataFrame, symbols: DataFrame) -> DataFrame:
    """bodies (body_id, body), catalog (repo), symbols (repo, id, counted) -> body_id, status: the first rule that a request breaks.

    413 size, 400 not JSON or no object, 400 repo, task or budget, 500 nothing stored for the repo, 400 pins or evicts, 400 an unknown id, 422 uncounted symbols, else 200.
    """
    v = F.try_parse_json("body")
    rows = bodies.select("body_id", F.length("body").alias("size"), v.alias("v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    text = lambda path: F.try_variant_get("v", path, "string")
    lists = lambda path: kind(path).isNull() | kind(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
    rows = rows.select(
        "body_id",
        "size",
        F.schema_of_variant("v").alias("kind"),
        F.when(kind("$.repo") == "STRING", text("$.repo")).alias("repo"),
        F.when(kind("$.task") == "STRING", text("$.task")).alias("task"),
        F.when(kind("$.budget") == "BIGINT", F.try_variant_get("v", "$.budget", "long")).alias("budget"),
        (lists("$.pins") & lists("$.evicts")).alias("arrays"),
        F.concat(F.coalesce(F.try_variant_get("v", "$.pins", "array<string>"), F.array()), F.coalesce(F.try_variant_get("v", "$.evicts", "array<string>"), F.array())).alias("ids"),
    )
    known = symbols.groupBy("repo").agg(F.bool_and("counted").alias("_counted"))
    missing = rows.select("body_id", "repo", F.explode("ids").alias("id")).join(symbols.select("repo", "id"), ["repo", "id"], "left_anti").select("body_id").distinct().withColumn("_unknown", F.lit(True))
    rows = rows.join(catalog.select("repo", F.lit(True).alias("_listed")), "repo", "left").join(known, "repo", "left").join(missing, "body_id", "left")
    status = (
        F.when(F.col("size") > MAX_BODY, 413)
        .when(F.col("kind").isNull() | ~F.col("kind").startswith("OBJECT"), 400)
        .when(F.col("repo").isNull() | ~F.col("repo").rlike("^[A-Za-z0-9_-]+$") | F.col("_listed").isNull(), 400)
        .when(F.col("task").isNull() | (F.trim("task") == ""), 400)
        .when(F.col("budget").isNull() | ~F.col("budget").isin(*BUDGETS), 400)
        .when(F.col("_counted").isNull(), 500)
        .when(~F.col("arrays"), 400)
        .when(F.col("_unknown"), 400)
        .when(~F.col("_counted"), 422)
        .otherwise(200)
    )
    return rows.select("body_id", status.cast("long").alias("status"))


def frames(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded chunks (keys, raw) -> keys, frame_no, text, and the usage counters. Line ends are unified, frames end at an empty line, the data lines of a frame are joined; [DONE] and what isn't JSON is left out."""
    schema = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,usageMetadata:struct<promptTokenCount:long,candidatesTokenCount:long,thoughtsTokenCount:long,totalTokenCount:long>>"
    split = raw.select(*keys, F.posexplode(F.split(F.regexp_replace("raw", "\r\n", "\n"), "\n\n")).alias("frame_no", "frame"))
    lines = F.filter(F.transform(F.split("frame", "\n"), F.trim), lambda x: x.startswith("data:"))
    payload = F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), "")
    parsed = split.select(*keys, "frame_no", payload.alias("payload")).where("payload <> '' AND payload <> '[DONE]'").withColumn("v", F.try_parse_json("payload")).where("v IS NOT NULL")
    c = F.from_json("payload", schema)
    texts = F.transform(F.get(c["candidates"], F.lit(0))["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit("")))
    use = c["usageMetadata"]
    return parsed.select(*keys, "frame_no", F.coalesce(F.array_join(texts, ""), F.lit("")).alias("text"), *(use[f"{n}TokenCount"].alias(n) for n in ("prompt", "candidates", "thoughts", "total")))


def last_usage(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Counters are running totals: the last that isn't null holds, 0 if there is none."""
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))), F.lit(0)).cast("long").alias(c)
    return rows.groupBy(key).agg(*map(last, ("prompt", "candidates", "thoughts", "total")))


def accounted(usage: DataFrame) -> DataFrame:
    """Add output (candidates and thoughts) and accounted: whether prompt and output make the total; a null total is taken as it is."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    output = zero("candidates") + zero("thoughts")
    return usage.withColumn("output", output).withColumn("accounted", F.col("total").isNull() | (zero("prompt") + output == F.col("total")))


def terminal_state(usage: DataFrame) -> DataFrame:
    state = F.when(F.col("total") == 0, "error: no usage").when(~F.col("accounted"), "error: mismatch").otherwise("done")
    return accounted(usage).withColumn("state", state)


def turn_state(end: str, prompt: int | None, candidates: int | None, thoughts: int | None, total: int | None) -> str:
    """The state in which a turn has ended: timeout and cancelled as they are, others by their counters, as terminal_state has it."""
    if end != "end":
        return {"timeout": "timeout", "cancel": "cancelled"}[end]
    if not total:
        return "error: no usage"
    return "done" if (prompt or 0) + (candidates or 0) + (thoughts or 0) == total else "error: mismatch"


def turn_ends(chunks: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Recorded chunks (turn_id, seq, at, kind, raw) -> turn_id, ended ('end', 'cancel' or 'timeout'), n_frames and raw: what a turn said until then, to its last empty line unless it ended by itself.

    A turn ends with its first row of another kind than 'chunk', or where the next row comes more than idle_seconds later; without either it has timed out.
    """
    by = Window.partitionBy("turn_id").orderBy("seq")
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(by) > idle_seconds * 1_000_000
    ends = F.when(gap, "timeout").when(F.col("kind") != "chunk", F.col("kind"))
    marked = chunks.withColumn("_end", ends)
    first = F.min(F.when(F.col("_end").isNotNull(), F.struct("seq", "_end")))
    marked = marked.withColumn("_first", first.over(Window.partitionBy("turn_id")))
    kept = F.when((F.col("kind") == "chunk") & (F.col("_first").isNull() | (F.col("seq") < F.col("_first.seq"))), F.struct("seq", F.coalesce("raw", F.lit("")).alias("raw")))
    by_turn = marked.groupBy("turn_id").agg(F.coalesce(F.first("_first._end"), F.lit("timeout")).alias("ended"), F.array_sort(F.collect_list(kept)).alias("_parts"))
    by_turn = by_turn.select("turn_id", "ended", F.regexp_replace(F.array_join(F.transform("_parts", lambda x: x["raw"]), ""), "\r\n", "\n").alias("raw"))
    by_turn = by_turn.withColumn("_pieces", F.split("raw", "\n\n")).withColumn("_open", F.size("_pieces") - 1)
    blank = ~F.element_at("_pieces", -1).rlike(r"\S")
    n = F.when((F.col("ended") == "end") & ~blank, F.size("_pieces")).otherwise(F.col("_open")).cast("long")
    raw = F.when(F.col("ended") == "end", F.col("raw")).otherwise(F.array_join(F.slice("_pieces", F.lit(1), F.col("_open")), "\n\n"))
    return by_turn.select("turn_id", "ended", n.alias("n_frames"), raw.alias("raw"))


def turn_frames(ended: DataFrame) -> DataFrame:
    """What turn_ends returns -> the rows that turns.frame_stream gives: that the turn is live, its frames, and the state in which it has ended."""
    found = frames(ended, ["turn_id"]).withColumn("frame_no", F.col("frame_no").cast("long"))
    counters = ["prompt", "candidates", "thoughts", "total"]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("frame_no"))).alias(c)
    use = ended.select("turn_id", "ended", "n_frames").join(found.groupBy("turn_id").agg(*map(last, counters)), "turn_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fits = zero("prompt") + zero("candidates") + zero("thoughts") == F.col("total")
    state = F.when(F.col("ended") == "cancel", "cancelled").when(F.col("ended") == "timeout", "timeout").when(zero("total") == 0, "error: no usage").when(fits, "done").otherwise("error: mismatch")
    said = found.select("turn_id", "frame_no", "text", *counters, F.lit(None).cast("string").alias("state"))
    live = ended.select("turn_id", F.lit(-1).cast("long").alias("frame_no"), F.lit("").alias("text"), *(F.lit(None).cast("long").alias(c) for c in counters), F.lit("live").alias("state"))
    return said.unionByName(live).unionByName(use.select("turn_id", F.col("n_frames").alias("frame_no"), F.lit("").alias("text"), *counters, state.alias("state")))


def project(usage: DataFrame, rates: DataFrame, serving: str = SERVING) -> DataFrame:
    """usage with prompt and output, for each rate: input_usd, output_usd, total_usd, free, served. Rates are a handful of rows."""
    price = lambda tokens, rate: F.col(tokens) * F.col(rate) / 1e6
    rows = usage.crossJoin(F.broadcast(rates)).withColumn("input_usd", price("prompt", "in_per_mtok")).withColumn("output_usd", price("output", "out_per_mtok"))
    return rows.withColumn("total_usd", F.col("input_usd") + F.col("output_usd")).withColumn("free", (F.col("in_per_mtok") == 0) & (F.col("out_per_mtok") == 0)).withColumn("served", F.col("model") == serving)


def quota(hits: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """hits (key, micros, hit_id: long) -> with n (place in its window) and allowed.

    A window opens with a key's first hit and doesn't slide; it is over `seconds` later. Blocked hits count, too. Rows are sorted by (key, micros, hit_id) in
    each partition and stream past a state of one key: memory doesn't grow with a key's hits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, n = None, 0, 0
        for batch in batches:
            places = []
            for k, at in zip(batch.column("key").to_pylist(), batch.column("micros").to_pylist(), strict=True):
                if k != key or at >= opened + seconds * 1_000_000:
                    key, opened, n = k, at, 0
                n += 1
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["key", "micros", "hit_id", "n"])

    rows = hits.select("key", "micros", "hit_id").repartition("key").sortWithinPartitions("key", "micros", "hit_id")
    return rows.mapInArrow(run, "key long, micros long, hit_id long, n long").withColumn("allowed", F.col("n") <= limit)


def global_cap(spend: DataFrame, bucket: str, order: list[str], ceiling: int = CEILING_CENTS) -> DataFrame:
    """Add before (cents spent by all rows before, in order) and allowed. Sums of buckets, which keep the order, come first, so no task holds all rows."""
    sums = spend.groupBy(bucket).agg(F.sum("cents").alias("_sum"))
    earlier = sums.select(F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = spend.withColumn("_inside", F.coalesce(F.sum("cents").over(inside), F.lit(0))).join(earlier, F.col(bucket) == F.col("_b"))
    return rows.withColumn("before", (F.col("_offset") + F.col("_inside")).cast("long")).withColumn("allowed", F.col("before") < ceiling).drop("_b", "_offset", "_inside")


def dispatch(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (call_id, tool, arg) -> call_id, tool, status, results: each tool is a column of symbols that its argument is looked up in."""
    tools = {"read_symbol": "id", "list_symbols": "file"}
    counts = None
    for tool, column in tools.items():
        own = calls.where(F.col("tool") == tool).join(symbols.select(F.col(column).alias("arg")), "arg").groupBy("call_id").agg(F.count(F.lit(1)).alias("results"))
        counts = own if counts is None else counts.unionByName(own)
    n = F.coalesce("results", F.lit(0))
    status = F.when(~F.col("tool").isin(*tools), 400).when(n > 0, 200).otherwise(404)
    return calls.join(counts, "call_id", "left").select("call_id", "tool", status.cast("long").alias("status"), n.alias("results"))


def bare_model(model: Column) -> Column:
    """A model's name without its vendor."""
    return F.regexp_replace(model, "^[^/]*/", "")


def client_key(forwarded: Column, real: Column) -> Column:
    """The first forwarded address, else the real one, else 'unknown'."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), real, F.lit("unknown"))
