"""Streams of turns: cut frames, cancels, timeouts, and events that are written once."""

import json
import random

from pyspark.sql import functions as F

from contextquarry.operators import serve
from contextquarry.streaming import sinks, turns

CHUNK = "turn_id long, seq long, at timestamp, kind string, raw string"
FRAMES = [
    'data: {"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}],"usageMetadata":{"promptTokenCount":6}}', 'data: {"usageMetadata":\ndata: {"candidatesTokenCount":3,"totalTokenCount":9}}', "data: {bad", "data: [DONE]", ": note",
    'data: {"candidates":[{"content":{"parts":[{"text":"é\\n"}]}}],"usageMetadata":{"thoughtsTokenCount":1,"totalTokenCount":10}}',
]


def chunks(spark, rows):
    """Rows with seconds as times."""
    return spark.createDataFrame([(t, s, float(at), k, r) for t, s, at, k, r in rows], "turn_id long, seq long, s double, kind string, raw string").select(
        "turn_id", "seq", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "kind", "raw"
    )


def ended_stream(spark, path, lots, name, sink=None):
    """The rows of a stream that reads one lot a batch, until the watermark is past all."""
    for k, lot in enumerate(lots):
        chunks(spark, lot).coalesce(1).write.parquet(f"{path}/lot{k:03d}")
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = turns.frame_stream(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=lambda r: (r[0], r[1]))


def test_turns_end_are_cancelled_or_time_out(spark, tmp_path):
    crlf = "\r\n\r\n".join(FRAMES[:2]) + "\r\n\r\n"
    cut = crlf.index("\r\n\r\n") + 1  # within a line end
    lots = [
        [(1, 0, 0, "chunk", crlf[:5]), (2, 0, 0, "chunk", FRAMES[0] + "\n\n" + FRAMES[5]), (3, 0, 0, "chunk", FRAMES[0] + "\n\npart"), (4, 0, 1, "chunk", FRAMES[0] + "\n\n" + FRAMES[1])],
        [(1, 1, 20, "chunk", crlf[5:cut]), (2, 1, 10, "cancel", None), (5, 0, 20, "end", None)],
        [(1, 2, 60, "chunk", crlf[cut:]), (2, 2, 61, "chunk", FRAMES[1] + "\n\n"), (4, 1, 40, "end", None)],
        [(1, 3, 90, "end", None), (3, 1, 91, "chunk", "too late\n\n")],
        [(9, 0, 1000, "chunk", "later")],  # moves the clock
        [(9, 1, 1010, "end", None)],
        [(10, 0, 5000, "end", None)],
    ]
    got = ended_stream(spark, str(tmp_path / "in"), lots, "turns_end")
    none = (None,) * 4
    assert [r for r in got if r[0] < 9] == [
        (1, -1, "", *none, "live"), (1, 0, "ab", 6, None, None, None, None), (1, 1, "", None, 3, None, 9, None), (1, 2, "", 6, 3, None, 9, "done"),
        (2, -1, "", *none, "live"), (2, 0, "ab", 6, None, None, None, None), (2, 1, "", 6, None, None, None, "cancelled"),
        (3, -1, "", *none, "live"), (3, 0, "ab", 6, None, None, None, None), (3, 1, "", 6, None, None, None, "timeout"),
        (4, -1, "", *none, "live"), (4, 0, "ab", 6, None, None, None, None), (4, 1, "", None, 3, None, 9, None), (4, 2, "", 6, 3, None, 9, "done"),
        (5, -1, "", *none, "live"), (5, 0, "", *none, "error: no usage"),
    ]


def random_turns(seed):
    """Turns cut at random places, with gaps, cancels, and ends that are missing."""
    rng, rows = random.Random(seed), []
    for t in range(60):
        whole = "".join(rng.choice(FRAMES) + rng.choice(["\n\n", "\r\n\r\n"]) for _ in range(rng.randint(0, 6))) + rng.choice(["", FRAMES[5], "data: {", "\n"])
        cuts = sorted(rng.sample(range(len(whole) + 1), min(len(whole), rng.randint(0, 5))))
        parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
        at = rng.randint(0, 30)
        own = []
        for part in parts:
            own.append([t, len(own), at, "chunk", part])
            at += rng.choice([1, 5, 44, 45, 46, 70]) if rng.random() < 0.3 else 2
        if rng.random() < 0.8:
            own.append([t, len(own), at, "end", None])
        if rng.random() < 0.2:
            own.insert(rng.randint(1, len(own)), [t, 0, at, "cancel", None])
        for k, r in enumerate(own):
            r[1] = k
            r[2] = max(r[2], own[k - 1][2]) if k else r[2]
        rows += own
    return rows


def test_the_batch_operator_says_what_the_stream_says(spark, tmp_path):
    rows = random_turns(3)
    batch = sorted((tuple(r) for r in serve.turn_frames(serve.turn_ends(chunks(spark, rows))).collect()), key=lambda r: (r[0], r[1]))
    lots = [sorted(rows, key=lambda r: r[2])[k : k + 90] for k in range(0, len(rows), 90)]
    # a stream only waits for those that the watermark hasn't passed, so lots come in the order of time
    stream = ended_stream(spark, str(tmp_path / "in"), [*lots, [(900, 0, 5000, "end", None)], [(901, 0, 9000, "end", None)]], "turns_batch")
    assert [r for r in stream if r[0] < 900] == batch
    assert {r[7] for r in batch} >= {"live", "done", "timeout", "cancelled", "error: no usage", None}


def test_events_are_written_once(spark, tmp_path):
    rows = serve.turn_frames(serve.turn_ends(chunks(spark, random_turns(5))))
    want = sorted(tuple(r) for r in sinks.events(rows).collect())
    rows.repartition(3).write.parquet(str(tmp_path / "rows"))
    out, mark = str(tmp_path / "out"), tmp_path / "mark"

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
        sinks.write_events(sinks.events(stream), out, str(mark)).awaitTermination(120)
        return sorted(tuple(r) for r in sinks.read_events(spark, out).collect())

    assert run() == want and run() == want
    newest = max((mark / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    newest.unlink()  # the last batch is run again: it replaces itself
    for f in (mark / "commits").glob(".*"):
        f.unlink()
    assert run() == want
    # a batch that failed before its commit isn't read
    spark.createDataFrame([(1, 1, "delta", "{}")], sinks.EVENT).write.parquet(f"{out}/events/run=other/batch=7")
    assert sorted(tuple(r) for r in sinks.read_events(spark, out).collect()) == want
    done = next(json.loads(p) for _, _, kind, p in want if kind == "done")
    assert done["outputTokens"] == done["usage"]["candidatesTokenCount"] + done["usage"]["thoughtsTokenCount"]
    assert [p["model"] for p in done["projection"]] == [r[0] for r in serve.RATES]
