"""Conversation structure repair: the cheapest edits that make roles alternate, by recursive queries over batches of conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextquarry.llm.common import arrow_batches, materialize
from contextquarry.llm.firsts import hash_columns, later_rows

#: States of the grammar (s?(ua)+)?: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Turns of a segment at most: longer conversations are repaired in segments, which are put together by their states.
SEGMENT_BITS = 7
#: Turns of a batch, and segments put together at once.
BATCH_TURNS, FAN = 20_000, 32
AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _moves() -> list[tuple[int, int, str, int, bool, str | None]]:
    """state, next state, letters, cost, whether the turn stays, the initial it needs: inserts before a turn, and then its own edit.

    Inserts come before a turn's own edit, so of two audits of the same turns neither begins with the other, and the least of
    longer ones begins with the least.
    """
    out = []
    for state in STATES:
        at, letters, cost = state, "", 0
        for _ in range(3):
            out.append((state, at, letters + "D", cost + DELETE, False, None))
            role = AFTER_INSERT[at]
            out.append((state, role, letters + "R", cost + REROLE, True, None))
            out.append((state, role, letters + "K", cost, True, "ua"[role == ASSISTANT]))
            if at == START:
                out.append((state, SYSTEM, letters + "K", cost, True, "s"))
            at, letters, cost = role, letters + "I", cost + INSERT
    return out


RECURSION = f"""
WITH RECURSIVE best(seg, i, start, state, cost, audit) AS (
  SELECT seg, 0, start, start, 0::BIGINT, '' FROM (SELECT DISTINCT seg FROM turns), range(4) t(start)
  UNION ALL
  SELECT seg, i, start, state, b.cost, b.audit FROM (
    SELECT d.seg, d.i + 1 AS i, d.start, m.next AS state,
           min({{'cost': d.cost + m.cost + CASE WHEN m.stays AND r.truncated THEN {TRUNCATED} ELSE 0 END, 'audit': d.audit || m.letters}}) AS b
    FROM best d JOIN turns r ON r.seg = d.seg AND r.i = d.i + 1
    JOIN moves m ON m.state = d.state AND (NOT m.stays OR (NOT (r.blank OR r.duplicate) AND (m.need IS NULL OR m.need = r.initial)))
    GROUP BY ALL)),
faults AS (
  SELECT seg, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, min_by(initial, i) AS first, max_by(initial, i) AS last
  FROM (SELECT *, lag(initial) OVER (PARTITION BY seg ORDER BY i) AS before FROM turns) GROUP BY seg)
SELECT f.seg, any_value(f.blank)::BIGINT AS blank, any_value(f.duplicate)::BIGINT AS duplicate, any_value(f.truncated)::BIGINT AS truncated, any_value(f.illegal)::BIGINT AS illegal,
       any_value(f.first) AS first, any_value(f.last) AS last, list({{'start': b.start::INT, 'state': b.state::INT, 'cost': b.cost, 'audit': b.audit}}) AS ways
FROM faults f JOIN best b ON b.seg = f.seg AND b.i = f.n GROUP BY f.seg ORDER BY f.seg
"""
WAYS = "ways array<struct<start:int,state:int,cost:bigint,audit:string>>"
FAULTS = ["blank", "duplicate", "truncated", "illegal"]
PART = f"{', '.join(f'{c} long' for c in FAULTS)}, first string, last string, {WAYS}"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and _role, _digest, _copy, which order rows of a turn: the rows after damage by crc32(conv_id:turn) % 20, with one space for nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("_role"), blank("text").alias("_text"), F.concat(blank("conv_id"), F.lit(":"), blank("turn")).alias("_key"))
    kind = F.crc32(F.col("_key").cast("binary")) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), "_role", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_digest"), F.explode(copies).alias("_copy")
    )


def _order(*first: str) -> list[Column]:
    return [*(F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn")), F.col("_role"), F.col("_digest"), F.col("_copy")]


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, initial, blank, duplicate, truncated, _at: _at grows with the order of conversations and turns. A range sort of digests, without texts, so a long conversation spreads over tasks."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    k1, k2 = hash_columns(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))
    slim = turns.select(
        "conv_id", "turn", "_role", "_digest", "_copy", F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"), (bare == "").alias("blank"),
        ((bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), k1.alias("k1"), k2.alias("k2"),
    )
    rows = slim.repartitionByRange(n, *_order()).sortWithinPartitions(*_order()).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows.drop("_role", "_digest", "_copy"), "turns")
    said = rows.where("NOT blank").select("k1", "k2", F.col("_at").alias("a"), F.lit(0).cast("long").alias("b"), F.col("_at").alias("_dup"))
    # a row that repeats a blank one is blank itself, so blank ones needn't be asked
    rows = rows.join(later_rows(said), F.col("_at") == F.col("_dup"), "left")
    duplicate = F.col("_dup").isNotNull()
    return rows.select("conv_id", "turn", "initial", "blank", duplicate.alias("duplicate"), (F.col("truncated") & ~duplicate).alias("truncated"), "_at")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ways through each segment: least cost and audit from each state to each state. Batches of whole segments are asked of DuckDB."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("CREATE TABLE moves (state INT, next INT, letters VARCHAR, cost BIGINT, stays BOOLEAN, need VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    names = ["initial", "blank", "duplicate", "truncated"]
    held, key, ids, segs, places = [], None, [], [], []

    def ask() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).select(names).append_column("seg", pa.array(segs, pa.int32())).append_column("i", pa.array(places, pa.int32()))
        con.register("batch", table)
        con.execute("CREATE OR REPLACE TEMP TABLE turns AS SELECT * FROM batch")
        found = con.sql(RECURSION).to_arrow_table().combine_chunks()
        con.unregister("batch")
        conv = pa.array([c for c, _ in ids], held[0].schema.field("conv_id").type)
        found = found.drop_columns(["seg"]).add_column(0, "conv_id", conv).add_column(1, "block", pa.array([b for _, b in ids], pa.int64()))
        for x in (held, ids, segs, places):
            x.clear()
        return found.to_batches()[0]

    for batch in batches:
        begin = 0
        for i, k in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            if k != key:
                if len(segs) >= BATCH_TURNS:
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield ask()
                    begin = i
                key = k
                ids.append(k)
                place = 0
            place += 1
            segs.append(len(ids) - 1)
            places.append(place)
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if segs:
        yield ask()


def _joined(a: dict, b: dict) -> dict:
    """What holds for two neighbouring segments together."""
    ways: dict[tuple[int, int], tuple[int, str]] = {}
    for x, y in product(a["ways"], b["ways"]):
        if x["state"] == y["start"]:
            at, way = (x["start"], y["state"]), (x["cost"] + y["cost"], x["audit"] + y["audit"])
            ways[at] = min(ways.get(at, way), way)
    both = {c: a[c] + b[c] for c in FAULTS} | {"first": a["first"], "last": b["last"]}
    both["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
    return both | {"ways": [{"start": s, "state": t, "cost": c, "audit": w} for (s, t), (c, w) in ways.items()]}


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and group of neighbouring segments, which come in order."""
    key, whole, schema, out = None, None, None, []

    def row() -> dict:
        return {"conv_id": key[0], "seq": key[1], **whole}

    for batch in batches:
        schema = batch.drop_columns(["seq"]).schema
        schema = pa.schema([pa.field("seq", pa.int64()) if f.name == "grp" else f for f in schema])
        for part in batch.to_pylist():
            k, part = (part["conv_id"], part["grp"]), {c: part[c] for c in (*FAULTS, "first", "last", "ways")}
            if k == key:
                whole = _joined(whole, part)
                continue
            if key is not None:
                out.append(row())
            key, whole = k, part
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, str | None, str | None]]:
    """('conversation', conv_id, None, None) where one begins, and ('turn', conv_id, role, text) for each turn that its audit leaves. Rows come by conversation, its audit first."""
    conv = letters = None
    state = START

    def inserted() -> Iterator[tuple]:
        nonlocal state
        while letters and letters[0][letters[1]] == "I":
            letters[1] += 1
            state = AFTER_INSERT[state]
            yield "turn", conv, ("user", "assistant")[state == ASSISTANT], ""

    for batch in batches:
        for audit, row_conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("audit", "conv_id", "role", "text")), strict=True):
            if audit is not None:
                conv, state, letters = row_conv, START, [audit + "$", 0]
                yield "conversation", conv, None, None
                yield from inserted()
                continue
            letter = letters[0][letters[1]]
            letters[1] += 1
            if letter != "D":
                state = SYSTEM if letter == "K" and role[:1] == "s" else AFTER_INSERT[state]
                yield "turn", conv, role if letter == "K" else ("user", "assistant")[state == ASSISTANT], text
            yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each repaired conversation, a turn at a time."""
    ids, digests, sha, sep, kind = [], [], None, b"", None

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests)], names=["_c", "repaired_sha256"])
        ids.clear()
        digests.clear()
        return out

    def peeked() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            yield batch

    for what, conv, role, text in _repaired(peeked()):
        if what == "conversation":
            if sha is not None:
                digests.append(sha.hexdigest())
            if len(digests) >= 4000:
                yield flush()
            ids.append(conv)
            sha, sep = hashlib.sha256(), b""
            continue
        sha.update(sep + f"{role}:{text}".encode())
        sep = b"\n"
    if sha is not None:
        digests.append(sha.hexdigest())
        yield flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn (from 0), role, text."""
    schema, turn, n, out = None, 0, 0, []

    def peeked() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for batch in batches:
            schema = pa.schema([batch.schema.field("conv_id"), pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])
            yield batch

    for what, conv, role, text in _repaired(peeked()):
        turn = 0 if what == "conversation" else turn + 1
        if what == "turn":
            out.append({"conv_id": conv, "turn": turn - 1, "role": role, "text": text})
            n += len(text)
        if len(out) >= 4000 or n > 4_000_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            n, out = 0, []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def audits(turns: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, gaps: one row per conversation that has turns."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(_numbered(turns), "judged-turns")
    block = F.shiftright(F.col("_at"), SEGMENT_BITS)
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.withColumn("block", block).repartition(n, "conv_id", "block").sortWithinPartitions("conv_id", "block", "_at")
    parts = arrow_batches(dealt.select("conv_id", "block", "initial", "blank", "duplicate", "truncated")).mapInArrow(_segments, f"conv_id {kind}, block long, {PART}")
    parts = materialize(parts, "segments")
    seq = parts.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1).cast("long").alias("seq"))
    parts = parts.join(seq, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b", "block")
    most = seq.agg(F.max("seq")).first()[0] or 0
    while most:
        grouped = parts.withColumn("grp", F.floor(F.col("seq") / FAN)).repartition(n, "conv_id", "grp").sortWithinPartitions("conv_id", "grp", "seq")
        parts = arrow_batches(grouped.select("conv_id", "grp", "seq", *FAULTS, "first", "last", "ways")).mapInArrow(_together, f"conv_id {kind}, seq long, {PART}")
        parts, most = materialize(parts, "conversations"), most // FAN
    tail = F.element_at(F.array(F.lit(""), F.lit("II"), F.lit("I"), F.lit("")), F.col("w.state") + 1)
    ends = parts.withColumn("w", F.explode("ways")).where("w.start = 0")
    ends = ends.select("conv_id", F.struct((F.col("w.cost") + INSERT * F.length(tail)).alias("cost"), F.concat("w.audit", tail).alias("audit")).alias("best"), *FAULTS)
    chosen = ends.groupBy("conv_id").agg(F.min("best").alias("best"), *(F.first(c).alias(c) for c in FAULTS)).select("conv_id", *FAULTS, "best.cost", "best.audit")
    each = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_x")).groupBy(F.col("conv_id").alias("_c"))
    spans = each.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return materialize(chosen.join(spans, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c"), "audits")


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns by conversation and in order, after a row with the conversation's audit."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.withColumns({"_turns": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = found.select("conv_id", F.lit(0).alias("_turns"), "audit")
    both = rows.unionByName(heads, allowMissingColumns=True)
    return arrow_batches(both.repartition(n, "conv_id").sortWithinPartitions(*_order("_turns")).select("conv_id", "audit", "role", "text"))


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text: the turns that the audits of found leave. turns: as damage returns them."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _with_audits(turns, found).mapInArrow(_rows, f"conv_id {kind}, turn long, role string, text string")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, after damage.

    Edits: K keeps a turn, R gives it the role that fits (user or assistant), D deletes it, I inserts an empty turn of the role that fits. The cheapest sequence of edits makes
    initials of roles (s?(ua)+)?; of equally cheap ones the least audit counts. Batches of segments of conversations are each one recursive query, which advances one turn
    for all of them and keeps the least cost and audit per state; segments of a long conversation are put together by their states. A conversation's SHA-256 needs its turns in
    order, so the last stream reads each in one task, a turn at a time.

    Nulls in any column are one space; a null conv_id is a conversation, and null turns come first. Rows of one turn are ordered by role and the MD5 of the text before damage. An empty role has the
    initial ' '. Very long texts count as digests but for the last stream. Repeated rows are duplicates. A conversation without rows after damage has zeros, an empty audit and
    the SHA-256 of nothing. Extra columns are ignored; an empty table gives no rows.
    """
    turns = damage(conversations)
    found = audits(turns)
    kind = turns.schema["conv_id"].dataType.simpleString()
    hashed = _with_audits(turns, found).mapInArrow(_digests, f"_c {kind}, repaired_sha256 string")
    numbers = ["gaps", *FAULTS, "cost"]
    found = found.withColumnRenamed("conv_id", "_f").join(hashed, F.col("_f").eqNullSafe(F.col("_c"))).drop("_c")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_f")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: CRC-32 of a string, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda p: ord(key[p])::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12_SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
coded AS (SELECT *, {_CRC} % 20 AS kind FROM given),
damaged AS (
  SELECT conv_id, turn, role AS role0, md5(text) AS digest, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, digest, copy) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN role = '' THEN ' ' ELSE role[1] END AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(regexp_replace(text, '[ 	-
]+$', ''), 1) NOT IN ('.', '!', '?') AS unended
  FROM placed),
turns AS (
  SELECT conv_id, turn, i, role, text, initial, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS truncated,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM judged),
moves(state, next, letters, cost, stays, need) AS (VALUES {{}}),
best(conv_id, i, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM turns
  UNION ALL
  SELECT conv_id, i, state, b.cost, b.audit FROM (
    SELECT d.conv_id, d.i + 1 AS i, m.next AS state, min({{{{'cost': (d.cost + m.cost + CASE WHEN m.stays AND r.truncated THEN {TRUNCATED} ELSE 0 END)::BIGINT, 'audit': d.audit || m.letters}}}}) AS b
    FROM best d JOIN turns r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1
    JOIN moves m ON m.state = d.state AND (NOT m.stays OR (NOT (r.blank OR r.duplicate) AND (m.need IS NULL OR m.need = r.initial))) GROUP BY ALL)),
lengths AS (
  SELECT conv_id, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM turns GROUP BY conv_id),
ends AS (
  SELECT l.*, (min({{{{'cost': b.cost + {INSERT} * t.more, 'audit': b.audit || repeat('I', t.more)}}}})) AS w
  FROM lengths l JOIN best b ON b.conv_id IS NOT DISTINCT FROM l.conv_id AND b.i = l.n JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) t(state, more) ON t.state = b.state GROUP BY ALL),
letters AS (SELECT conv_id, unnest(string_split(w.audit, '')) AS letter, unnest(range(1, length(w.audit) + 1)) AS p FROM ends WHERE w.audit <> ''),
edits AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS q FROM edits WHERE letter <> 'D'),
filled AS (
  SELECT k.conv_id, k.q, k.letter, r.role, CASE WHEN k.letter = 'I' THEN '' ELSE r.text END AS text, first_value(k.letter = 'K' AND r.initial = 's') OVER (PARTITION BY k.conv_id ORDER BY k.q) AS opened
  FROM kept k LEFT JOIN turns r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.i),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY q) AS said FROM filled GROUP BY conv_id)
SELECT c.conv_id, coalesce(e.gaps, 0)::BIGINT AS gaps, coalesce(e.blank, 0)::BIGINT AS blank, coalesce(e.duplicate, 0)::BIGINT AS duplicate, coalesce(e.truncated, 0)::BIGINT AS truncated,
       coalesce(e.illegal, 0)::BIGINT AS illegal, coalesce(e.w.cost, 0)::BIGINT AS cost, coalesce(e.w.audit, '') AS audit, sha256(coalesce(s.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
""".format(", ".join(f"({state}, {to}, '{letters}', {cost}, {stays}, {f"'{need}'" if need else 'NULL'})" for state, to, letters, cost, stays, need in _moves()))
