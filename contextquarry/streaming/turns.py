"""Structured Streaming: quotas by key, and chunks of turns that end, are cancelled or time out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contextquarry.operators.serve import IDLE_SECONDS, LIMIT, WINDOW_SECONDS, turn_state

DECISION = "key string, hit_id long, ts timestamp, n long, allowed boolean"
FRAME = "turn_id long, frame_no long, text string, prompt long, candidates long, thoughts long, total long, state string"


def quota_stream(hits: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """hits (key, hit_id, ts) -> a decision for each, in append mode.

    State of a key: when its window opened, and hits so far. A window opens with a key's first hit and is over `seconds` later; state is dropped when the watermark
    passes that. Hits of a batch are taken in the order of ts and hit_id.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "hit_id"])
        places = []
        for at in rows["ts"]:
            micros = at.value // 1000
            if opened is None or micros >= opened + seconds * 1_000_000:
                opened, n = micros, 0
            n += 1
            places.append(n)
        state.update((opened, n))
        state.setTimeoutTimestamp(max(opened // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "hit_id": rows["hit_id"], "ts": rows["ts"], "n": places, "allowed": [p <= limit for p in places]})

    keyed = hits.withWatermark("ts", "1 minute").groupBy("key")
    return keyed.applyInPandasWithState(decide, DECISION, "opened long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def read_frame(frame: str) -> dict | None:
    """The text and counters of one frame; None for [DONE], nothing, or what isn't a JSON object."""
    payload = "".join(line.strip()[5:].strip() for line in frame.split("\n") if line.strip().startswith("data:"))
    if payload in ("", "[DONE]"):
        return None
    try:
        value = json.loads(payload)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    first = (value.get("candidates") or [{}])[0]
    parts = (first.get("content") or {}).get("parts") or []
    use = value.get("usageMetadata") or {}
    return {"text": "".join(p.get("text") or "" for p in parts)} | {c: use.get(f"{c}TokenCount") for c in ("prompt", "candidates", "thoughts", "total")}


class Turn(StatefulProcessor):
    """State of a turn: what follows its last empty line, frames and counters so far, when its last chunk came, and whether it has ended."""

    COUNTERS = ("prompt", "candidates", "thoughts", "total")

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        counters = ", ".join(f"{c} long" for c in self.COUNTERS)
        self.turn = handle.getValueState("turn", f"rest string, n long, last long, ended boolean, {counters}")

    def _read(self, frames: list[str], n: int, use: list) -> tuple[list[dict], int]:
        out = []
        for frame in frames:
            if (found := read_frame(frame)) is not None:
                out.append({"frame_no": n, **found})
                use[:] = [u if found[c] is None else found[c] for c, u in zip(self.COUNTERS, use, strict=True)]
            n += 1
        return out, n

    def _end(self, state: str, n: int, use: list) -> dict:
        return {"frame_no": n, "text": "", "state": turn_state(state, *use)} | dict(zip(self.COUNTERS, use, strict=True))

    def _rows(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame([{"turn_id": key[0], "state": None, **r} for r in rows], columns=[x.split()[0] for x in FRAME.split(", ")])
        return frame.astype({c: "Int64" for c in ("turn_id", "frame_no", *self.COUNTERS)})

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        held = self.turn.get() if self.turn.exists() else ("", 0, None, False, None, None, None, None)
        rest, n, last, ended, *use = held
        out = [] if last is not None else [{"frame_no": -1, "text": "", "state": "live"}]
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if ended:
                break  # what comes after the end is nobody's
            at = r.at.value // 1_000_000
            if last is not None and at > last + self.idle:
                ended = "timeout"
            elif r.kind in ("end", "cancel"):
                ended, last = r.kind, at
            else:
                # a chunk may end between the two characters of a line end
                *done, rest = (rest + (r.raw if isinstance(r.raw, str) else "")).replace("\r\n", "\n").split("\n\n")
                found, n = self._read(done, n, use)
                out += found
                last = at
            if ended:
                if ended == "end" and rest.strip():
                    found, n = self._read([rest], n, use)
                    out += found
                out.append(self._end(ended, n, use))
                rest = ""
        self.turn.update((rest, n, last, bool(ended), *use))
        self._wake(last + self.idle + 1)  # the end of a turn is remembered as long, so late chunks don't begin it anew
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, n, _, ended, *use = self.turn.get()
        self.turn.clear()
        yield self._rows(key, [] if ended else [self._end("timeout", n, use)])

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, idle_seconds: int = IDLE_SECONDS, lateness: str = "10 seconds") -> DataFrame:
    """chunks (turn_id, seq, at, kind, raw) -> rows of each turn, in append mode: one of the state 'live', its frames, and its end with another state.

    kind: 'chunk', 'end' or 'cancel'. A chunk may end anywhere, so what follows a turn's last empty line waits in its state; the end makes it the last frame. A turn without a chunk for idle_seconds, by
    the time of chunks (at) and of the watermark, which is `lateness` behind, ends with the state 'timeout', and a cancelled one with 'cancelled': what they were waiting with is dropped. States of others
    are those of turn_state. The end's row has the latest counters. Chunks after the end are left out. Needs the state store STATE_STORE.
    """
    watermarked = chunks.select("turn_id", "seq", "at", "kind", "raw").withWatermark("at", lateness)
    return watermarked.groupBy("turn_id").transformWithStateInPandas(Turn(idle_seconds), outputStructType=FRAME, outputMode="append", timeMode="eventTime")


def usage_stream(frames: DataFrame) -> DataFrame:
    """The latest counters of each turn, in update mode: counters are running totals, so the greatest frame that has one holds."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("frame_no"))).alias(c)
    return frames.groupBy("turn_id").agg(*map(last, ("prompt", "candidates", "thoughts", "total")))
