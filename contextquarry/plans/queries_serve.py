"""Queries of admission, tools, recorded streams, usage, prices and quotas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contextquarry.catalog import query
from contextquarry.functions.text import estimate, estimate_sql
from contextquarry.operators import serve
from contextquarry.scratch import scratch
from contextquarry.sources import tables as T
from contextquarry.streaming import ceiling

_B = '"task":"red","budget":4000'
#: What each body breaks, in the order of the rules.
BODIES = [
    (1, '{"repo":"documents","task":"the","budget":4000}'),
    (2, '{"repo":"parts","task":"red","budget":8000,"pins":["p:1"],"evicts":["p:2","p:3"]}'),
    (3, "not json"),
    (4, "[1, 2]"),
    (5, '{"repo":"../etc","task":"x","budget":4000}'),
    (6, '{"repo":"nowhere","task":"x","budget":4000}'),
    (7, '{"repo":7,"task":"x","budget":4000}'),
    (8, '{"repo":"parts","task":"   ","budget":4000}'),
    (9, '{"repo":"parts","task":"x","budget":5000}'),
    (10, '{"repo":"parts","task":"x","budget":"4000"}'),
    (11, f'{{"repo":"unreadable",{_B}}}'),
    (12, f'{{"repo":"parts",{_B},"pins":"p:1"}}'),
    (13, f'{{"repo":"parts",{_B},"evicts":[1]}}'),
    (14, f'{{"repo":"parts",{_B},"pins":["p:1","p:none"]}}'),
    (15, f'{{"repo":"uncounted",{_B}}}'),
    (16, f'{{"repo":"parts",{_B},"pins":[]}}'),
    (17, '{"repo":"parts","task":"' + "x" * 66_000 + '","budget":4000}'),
]
CATALOG = ["documents", "parts", "unreadable", "uncounted"]
_BODIES_SQL = ", ".join(f"({i}::BIGINT, " + (f"'{b}'" if i != 17 else """'{"repo":"parts","task":"' || repeat('x', 66000) || '","budget":4000}'""") + ")" for i, b in BODIES)
_CATALOG_SQL = ", ".join(f"('{c}')" for c in CATALOG)
_LISTS = " AND ".join(f"(json_type(j, '$.{p}') IS NULL OR (json_type(j, '$.{p}') = 'ARRAY' AND len(list_filter(json_extract(j, '$.{p}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0))" for p in ("pins", "evicts"))
_ADMISSION = f"""
bodies AS (SELECT * FROM (VALUES {_BODIES_SQL}) t(body_id, body)),
stored AS (SELECT repo, id, true AS counted FROM symbols UNION ALL SELECT 'uncounted', 'u:1', false),
parsed AS (SELECT body_id, body, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM bodies),
fields AS (SELECT *, CASE WHEN json_type(j, '$.repo') = 'VARCHAR' THEN j->>'$.repo' END AS repo, CASE WHEN json_type(j, '$.task') = 'VARCHAR' THEN j->>'$.task' END AS task,
                  CASE WHEN json_type(j, '$.budget') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.budget')::BIGINT END AS budget, {_LISTS} AS arrays FROM parsed),
status AS (
  SELECT body_id, CASE WHEN length(body) > {serve.MAX_BODY} THEN 413 WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 400
    WHEN repo IS NULL OR NOT regexp_full_match(repo, '[A-Za-z0-9_-]+') OR repo NOT IN (SELECT * FROM (VALUES {_CATALOG_SQL})) THEN 400
    WHEN task IS NULL OR trim(task) = '' THEN 400 WHEN budget IS NULL OR budget NOT IN {serve.BUDGETS} THEN 400
    WHEN NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo = f.repo) THEN 500 WHEN NOT arrays THEN 400
    WHEN EXISTS (SELECT 1 FROM (SELECT unnest(list_concat(coalesce(json_extract_string(j, '$.pins[*]'), []), coalesce(json_extract_string(j, '$.evicts[*]'), []))) AS id) x
                 WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.repo = f.repo AND s.id = x.id)) THEN 400
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.repo = f.repo AND NOT counted) THEN 422 ELSE 200 END::BIGINT AS status FROM fields f)"""


def _stored(spark, d):
    return T.symbols(spark, d).select("repo", "id", F.col("tokens").isNotNull().alias("counted")).unionByName(spark.createDataFrame([("uncounted", "u:1", False)], "repo string, id string, counted boolean"))


@query("request_admission", f"WITH {T.SYMBOLS},{_ADMISSION} SELECT * FROM status")
def request_admission(spark, d):
    bodies = spark.createDataFrame(BODIES, "body_id long, body string")
    return serve.admission(bodies, spark.createDataFrame([(c,) for c in CATALOG], "repo string"), _stored(spark, d))


ASKED_IDS = [(1, "parts", "p:1"), (1, "parts", "p:none"), (2, "parts", "s:1"), (3, "documents", "nowhere::1"), (3, "parts", "q")]
_ASKED_SQL = ", ".join(f"({a}::BIGINT, '{b}', '{c}')" for a, b, c in ASKED_IDS)


@query("invalid_ids", f"WITH {T.SYMBOLS} SELECT a.request_id, a.repo, a.id FROM (VALUES {_ASKED_SQL}) a(request_id, repo, id) WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = a.repo AND s.id = a.id)")
def invalid_ids(spark, d):
    return spark.createDataFrame(ASKED_IDS, "request_id long, repo string, id string").join(T.symbols(spark, d).select("repo", "id"), ["repo", "id"], "left_anti").select("request_id", "repo", "id")


@query(
    "refusals",
    f"""WITH {T.SYMBOLS}, stored AS (SELECT repo, true AS counted, 'estimate' AS source FROM symbols UNION ALL SELECT 'uncounted', false, NULL UNION ALL SELECT 'counted', true, 'count_tokens')
    SELECT repo, CASE WHEN NOT bool_and(counted) THEN 'uncounted' END AS pack_refusal, CASE WHEN NOT bool_and(counted) OR max(source) <> 'count_tokens' THEN 'needs counted tokens' END AS step_refusal FROM stored GROUP BY repo""",
)
def refusals(spark, d):
    """Packs need costs for every symbol; turns need them counted, not estimated."""
    more = spark.createDataFrame([("uncounted", False, None), ("counted", True, "count_tokens")], "repo string, counted boolean, source string")
    rows = T.symbols(spark, d).select("repo", F.col("tokens").isNotNull().alias("counted"), F.lit("estimate").alias("source")).unionByName(more)
    by = rows.groupBy("repo").agg(F.bool_and("counted").alias("c"), F.max("source").alias("s"))
    return by.select("repo", F.when(~F.col("c"), "uncounted").alias("pack_refusal"), F.when(~F.col("c") | (F.col("s") != "count_tokens"), "needs counted tokens").alias("step_refusal"))


SELECTIONS = [(1, [(1, "full"), (2, "skeleton")]), (2, [(1, "signature"), (1, "signature")]), (3, [(1, "huge")]), (4, [(-5, "full")]), (5, [(i, "full") for i in range(60)])]
_SELECTED = ", ".join(f"({s}::BIGINT, {o}::BIGINT, '{t}')" for s, rows in SELECTIONS for o, t in rows)
_COST = "CASE tier WHEN 'full' THEN c_full WHEN 'skeleton' THEN c_skel WHEN 'signature' THEN c_sig END"


@query(
    "selection_check",
    f"""WITH {T.SYMBOLS} SELECT x.selection_id, CASE WHEN bool_or(s.id IS NULL) THEN 'unknown id' WHEN bool_or(x.tier NOT IN ('full', 'skeleton', 'signature')) THEN 'tier'
    WHEN count(*) > count(DISTINCT s.id) THEN 'duplicate' WHEN sum({_COST}) > 4000 THEN 'over budget' ELSE 'ok' END AS verdict
    FROM (VALUES {_SELECTED}) x(selection_id, ord, tier) LEFT JOIN symbols s ON s.repo = 'documents' AND s.ord = x.ord GROUP BY x.selection_id""",
)
def selection_check(spark, d):
    rows = spark.createDataFrame([(s, o, t) for s, own in SELECTIONS for o, t in own], "selection_id long, ord long, tier string")
    rows = rows.join(T.document_symbols(spark, d).select("ord", "id", "tokens"), "ord", "left")
    cost = F.when(F.col("tier") == "full", F.col("tokens.full")).when(F.col("tier") == "skeleton", F.col("tokens.skeleton")).when(F.col("tier") == "signature", F.col("tokens.signature"))
    by = rows.groupBy("selection_id").agg(F.bool_or(F.col("id").isNull()).alias("u"), F.bool_or(~F.col("tier").isin("full", "skeleton", "signature")).alias("t"), (F.count(F.lit(1)) > F.countDistinct("id")).alias("dup"), F.sum(cost).alias("c"))
    return by.select("selection_id", F.when(F.col("u"), "unknown id").when(F.col("t"), "tier").when(F.col("dup"), "duplicate").when(F.col("c") > 4000, "over budget").otherwise("ok").alias("verdict"))


# tools


@query("tool_read_symbol", f"WITH {T.SYMBOLS} SELECT id, kind, signature, c_full AS tokens FROM symbols WHERE repo = 'parts' AND id = 'p:7'")
def tool_read_symbol(spark, d):
    return T.symbols(spark, d).where("repo = 'parts' AND id = 'p:7'").select("id", "kind", "signature", F.col("tokens.full").alias("tokens"))


@query("tool_list_symbols", f"WITH {T.SYMBOLS} SELECT id, name, c_sig AS tokens FROM symbols WHERE repo = 'documents' AND file = 'src3' ORDER BY ord")
def tool_list_symbols(spark, d):
    return T.symbols(spark, d).where("repo = 'documents' AND file = 'src3'").orderBy("ord").select("id", "name", F.col("tokens.signature").alias("tokens"))


@query("tool_read_file", "SELECT url AS path, sha256(html) AS content_sha256 FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id IN (1, 2, 5)) AND url <> 'file://unknown'")
def tool_read_file(spark, d):
    """The content of asked paths that are stored; others are refused."""
    pages = T.table(spark, d, "pages")
    asked = pages.where(F.col("page_id").isin(1, 2, 5)).select(F.col("url").alias("path")).union(spark.createDataFrame([("file://unknown",)], "path string")).distinct()
    return pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("content_sha256")).join(asked, "path", "left_semi")


CALLS = [(1, "read_symbol", "p:7"), (2, "read_symbol", "p:none"), (3, "list_symbols", "Brand#13"), (4, "list_symbols", "no file"), (5, "delete_symbol", "p:7")]
_CALLS = ", ".join(f"({i}::BIGINT, '{t}', '{a}')" for i, t, a in CALLS)


@query(
    "tool_dispatch",
    f"""WITH {T.PART_SYMBOLS}, calls AS (SELECT * FROM (VALUES {_CALLS}) t(call_id, tool, arg)),
    hits AS (SELECT c.call_id, count(s.id) AS n FROM calls c LEFT JOIN part_symbols s ON (c.tool = 'read_symbol' AND s.id = c.arg) OR (c.tool = 'list_symbols' AND s.file = c.arg) GROUP BY c.call_id)
    SELECT c.call_id, c.tool, CASE WHEN c.tool IN ('read_symbol', 'list_symbols') THEN CASE WHEN n > 0 THEN 200 ELSE 404 END ELSE 400 END::BIGINT AS status, n AS results
    FROM calls c JOIN hits h ON h.call_id = c.call_id""",
)
def tool_dispatch(spark, d):
    """Calls by the name of their tool: its number of results, 404 if there are none, 400 for a tool that isn't known."""
    calls = spark.createDataFrame(CALLS, "call_id long, tool string, arg string")
    return serve.dispatch(calls, T.part_symbols(spark, d))


SHOWN = 40


@query("display_list", f"WITH {T.SYMBOLS} SELECT id, name, count(*) OVER () - {SHOWN} AS more FROM symbols WHERE repo = 'documents' QUALIFY row_number() OVER (ORDER BY ord) <= {SHOWN}")
def display_list(spark, d):
    """What a list shows: the first 40 in order, and how many more there are. The limit is the feature."""
    rows = T.document_symbols(spark, d)
    more = rows.agg((F.count(F.lit(1)) - SHOWN).alias("more"))
    return rows.orderBy("ord").limit(SHOWN).select("id", "name").crossJoin(F.broadcast(more))  # one row


@query(
    "model_names",
    """WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN source || '/' || coalesce(lang, '') || '/' || doc_id WHEN 2 THEN lang ELSE '/' || source END AS model FROM documents)
    SELECT doc_id, model, regexp_replace(model, '^[^/]*/', '') AS name FROM m""",
)
def model_names(spark, d):
    """Names of models, some after a vendor's name: here made of the sources and languages of documents."""
    i, lang = F.col("doc_id"), F.coalesce("lang", F.lit(""))
    model = F.when(i % 4 == 1, F.concat("source", F.lit("/"), lang, F.lit("/"), i.cast("string"))).when(i % 4 == 2, F.col("lang")).when(i % 4 == 3, F.concat(F.lit("/"), "source"))
    return T.table(spark, d, "documents").select("doc_id", model.alias("model")).withColumn("name", serve.bare_model(F.col("model")))


@query(
    "client_keys",
    """WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' 10.0.0.' || page_id || ' , 10.1.1.1' WHEN 2 THEN ' , 10.2.2.2' ELSE '10.3.3.' || page_id END AS forwarded,
                      CASE WHEN page_id % 3 = 0 THEN '192.0.2.' || page_id END AS real_ip FROM pages)
    SELECT page_id, coalesce(nullif(trim(split_part(forwarded, ',', 1)), ''), real_ip, 'unknown') AS client FROM h""",
)
def client_keys(spark, d):
    """Who is counted for a request: the first forwarded address, else the real one, else 'unknown'."""
    p = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    forwarded = F.when(kind == 1, F.concat(F.lit(" 10.0.0."), p, F.lit(" , 10.1.1.1"))).when(kind == 2, F.lit(" , 10.2.2.2")).when(kind == 3, F.concat(F.lit("10.3.3."), p))
    real = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("192.0.2."), p))
    return T.table(spark, d, "pages").select("page_id", serve.client_key(forwarded, real).alias("client"))


# messages and recorded streams


@query(
    "message_whitelist",
    "SELECT conv_id, count(*) AS messages, bool_and(role IN ('user', 'assistant') AND text IS NOT NULL) AS valid FROM conversations GROUP BY conv_id",
)
def message_whitelist(spark, d):
    """Conversations of user and model turns with text only; others are refused."""
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    good = role.isin("user", "model") & F.col("text").isNotNull()
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.bool_and(good).alias("valid"))


@query(
    "validated_messages",
    """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text FROM conversations c
    WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND (x.role NOT IN ('user', 'assistant') OR x.text IS NULL))""",
)
def validated_messages(spark, d):
    """The messages of conversations that pass, built anew from the checked fields only."""
    good = message_whitelist(spark, d).where("valid").select("conv_id")
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return T.table(spark, d, "conversations").join(good, "conv_id").select("conv_id", "turn", role.alias("role"), "text")


def raw_frames(spark, d):
    """Conversations as recorded chunks: a frame per turn with its text in two parts and counters so far, some with a closing mark, some with a broken frame."""
    t = F.col("turn")
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    parts = F.array(F.struct(F.substring(text, F.lit(1), half).alias("text")), F.struct(F.substring(text, half + 1, F.length(text)).alias("text")))
    content = F.to_json(F.struct(parts.alias("parts")))
    count = lambda n: F.when(t % n == 0, F.lit("null")).otherwise((t * n).cast("string"))
    frame = F.concat(
        F.lit('data: {"candidates":[{"content":'), content, F.lit('}],\r\ndata: "usageMetadata":{"promptTokenCount":'), count(3),
        F.lit(',"candidatesTokenCount":'), count(2), F.lit(',"totalTokenCount":'), (t * 5).cast("string"), F.lit("}}\r\n\r\n"),
    )
    raw = F.concat(frame, F.when(t % 3 == 0, F.lit("data: [DONE]\r\n\r\n")).otherwise(""), F.when(t % 4 == 1, F.lit("data: {broken\r\n\r\n")).otherwise(""))
    return T.table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))


_COUNT = lambda n: f"CASE WHEN turn % {n} = 0 THEN NULL ELSE turn * {n} END"
_FRAMES = f"frames AS (SELECT conv_id, turn, 0 AS frame_no, coalesce(text, '') AS text, {_COUNT(3)} AS prompt, {_COUNT(2)} AS candidates, NULL::BIGINT AS thoughts, turn * 5 AS total FROM conversations)"


@query("sse_frames", f"WITH {_FRAMES} SELECT conv_id, turn, frame_no, text, prompt, candidates, total FROM frames")
def sse_frames(spark, d):
    return serve.frames(raw_frames(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "frame_no", "text", "prompt", "candidates", "total")


@query("sse_text", f"WITH {_FRAMES} SELECT conv_id, string_agg(text, '' ORDER BY turn, frame_no) AS text FROM frames GROUP BY conv_id")
def sse_text(spark, d):
    rows = serve.frames(raw_frames(spark, d), ["conv_id", "turn"])
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame_no", "text"))), lambda x: x["text"]), "").alias("text"))


_LAST = ", ".join(f"coalesce(last({c} ORDER BY turn, frame_no) FILTER ({c} IS NOT NULL), 0)::BIGINT AS {c}" for c in ("prompt", "candidates", "thoughts", "total"))


@query("usage_last_wins", f"WITH {_FRAMES} SELECT conv_id, {_LAST} FROM frames GROUP BY conv_id")
def usage_last_wins(spark, d):
    return serve.last_usage(serve.frames(raw_frames(spark, d), ["conv_id", "turn"]), "conv_id", ["turn", "frame_no"])


_STATE = f"u AS (SELECT conv_id, {_LAST} FROM frames GROUP BY conv_id)"


@query("terminal_state", f"WITH {_FRAMES}, {_STATE} SELECT conv_id, CASE WHEN total = 0 THEN 'error: no usage' WHEN prompt + candidates + thoughts <> total THEN 'error: mismatch' ELSE 'done' END AS state FROM u")
def terminal_state(spark, d):
    return serve.terminal_state(usage_last_wins(spark, d)).select("conv_id", "state")


@query("latest_replay", "SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_replay(spark, d):
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query(
    "replay_fallback",
    f"""WITH {_FRAMES}, live AS (SELECT conv_id, string_agg(text, '' ORDER BY turn, frame_no) AS text FROM frames WHERE conv_id % 3 <> 0 GROUP BY conv_id), old AS (SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY conv_id)
    SELECT old.conv_id, coalesce(live.text, old.text) AS text, live.conv_id IS NULL AS replayed FROM old LEFT JOIN live ON live.conv_id = old.conv_id""",
)
def replay_fallback(spark, d):
    """Turns that failed upstream (every third here) are answered from the latest record, and say so."""
    live = sse_text(spark, d).where("conv_id % 3 <> 0").select("conv_id", F.col("text").alias("live"))
    return latest_replay(spark, d).join(live, "conv_id", "left").select("conv_id", F.coalesce("live", "text").alias("text"), F.col("live").isNull().alias("replayed"))


def recorded_chunks(spark, d):
    """Conversations as turns in chunks with times: a chunk per row, half a step of conv_id % 60 seconds for each number of seq. Some are cancelled, some never end, some end within a frame."""
    c = F.col("conv_id")
    rows = raw_frames(spark, d)
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = rows.join(last, "conv_id")
    cut = F.when((c % 4 == 2) & (F.col("turn") == F.col("last")), F.substring("raw", F.lit(1), F.length("raw") - 4)).otherwise(F.col("raw"))
    chunks = rows.select("conv_id", (F.col("turn") * 2).alias("seq"), F.lit("chunk").alias("kind"), cut.alias("raw"))
    none = F.lit(None).cast("string").alias("raw")
    ends = last.where(c % 5 != 0).select("conv_id", (F.col("last") * 2 + 2).alias("seq"), F.lit("end").alias("kind"), none)
    cancels = last.where(c % 7 == 3).select("conv_id", F.lit(3).cast("long").alias("seq"), F.lit("cancel").alias("kind"), none)
    at = F.timestamp_millis(F.lit(1_767_225_600_000) + F.col("seq") * (c % 60) * 500)
    return chunks.unionByName(ends).unionByName(cancels).select(c.alias("turn_id"), "seq", at.alias("at"), "kind", "raw")


_N_IN = "1 + (turn % 3 = 0)::BIGINT + (turn % 4 = 1)::BIGINT"
_ENDED = f"""
lasts AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
chunks AS (
  SELECT conv_id, turn * 2 AS seq, 'chunk' AS kind FROM conversations
  UNION ALL SELECT conv_id, last * 2 + 2, 'end' FROM lasts WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, 3, 'cancel' FROM lasts WHERE conv_id % 7 = 3),
told AS (
  SELECT *, CASE WHEN (seq - lag(seq) OVER (PARTITION BY conv_id ORDER BY seq)) * (conv_id % 60) * 500 > {serve.IDLE_SECONDS * 1000} THEN 'timeout' WHEN kind <> 'chunk' THEN kind END AS stop FROM chunks),
stops AS (SELECT conv_id, min(seq) FILTER (stop IS NOT NULL) AS at, coalesce(arg_min(stop, seq) FILTER (stop IS NOT NULL), 'timeout') AS ended FROM told GROUP BY conv_id),
kept AS (
  SELECT c.conv_id, c.turn, coalesce(c.text, '') AS text, s.ended, {_N_IN} AS n_in, c.conv_id % 4 = 2 AND c.turn = l.last AND s.ended <> 'end' AS lost,
         coalesce(sum({_N_IN}) OVER (PARTITION BY c.conv_id ORDER BY c.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame_no
  FROM conversations c JOIN stops s ON s.conv_id = c.conv_id AND (s.at IS NULL OR c.turn * 2 < s.at) JOIN lasts l ON l.conv_id = c.conv_id),
said AS (SELECT conv_id AS turn_id, frame_no, text, {_COUNT(3)} AS prompt, {_COUNT(2)} AS candidates, NULL::BIGINT AS thoughts, turn * 5 AS total FROM kept WHERE NOT (lost AND n_in = 1)),
counted AS (SELECT turn_id, {", ".join(f"arg_max({c}, frame_no) FILTER ({c} IS NOT NULL) AS {c}" for c in ("prompt", "candidates", "thoughts", "total"))} FROM said GROUP BY turn_id),
lengths AS (SELECT conv_id, sum(n_in - lost::BIGINT)::BIGINT AS frame_no FROM kept GROUP BY conv_id),
turn_rows AS (
  SELECT *, NULL AS state FROM said UNION ALL SELECT conv_id, -1, '', NULL, NULL, NULL, NULL, 'live' FROM stops
  UNION ALL SELECT s.conv_id, coalesce(n.frame_no, 0), '', c.prompt, c.candidates, c.thoughts, c.total,
    CASE WHEN ended = 'cancel' THEN 'cancelled' WHEN ended = 'timeout' THEN ended WHEN coalesce(c.total, 0) = 0 THEN 'error: no usage'
         WHEN coalesce(c.prompt, 0) + coalesce(c.candidates, 0) + coalesce(c.thoughts, 0) = c.total THEN 'done' ELSE 'error: mismatch' END
  FROM stops s LEFT JOIN lengths n ON n.conv_id = s.conv_id LEFT JOIN counted c ON c.turn_id = s.conv_id)"""


def _turn_frames(spark, d):
    return serve.turn_frames(serve.turn_ends(recorded_chunks(spark, d)))


@query("turn_frames", f"WITH {_ENDED} SELECT turn_id, frame_no, text, prompt, candidates, total, state FROM turn_rows")
def turn_frames(spark, d):
    """Turns that ended, were cancelled or timed out, as streams of chunks give them."""
    return _turn_frames(spark, d).drop("thoughts")


@query(
    "turn_events",
    f"""WITH {_ENDED} SELECT turn_id, frame_no + 1 AS seq, CASE WHEN state IS NULL THEN 'delta' WHEN state = 'live' THEN 'status' WHEN state IN ('done', 'cancelled') THEN state ELSE 'error' END AS type,
    CASE WHEN state IS NULL THEN text END AS text, CASE WHEN state = 'done' THEN total END AS total, CASE WHEN state = 'done' THEN coalesce(candidates, 0) + coalesce(thoughts, 0) END AS output,
    CASE WHEN state NOT IN ('live', 'done', 'cancelled') THEN state END AS error FROM turn_rows WHERE state IS NOT NULL OR text <> ''""",
)
def turn_events(spark, d):
    """The events of turns, read back from their JSON."""
    from contextquarry.streaming.sinks import events

    of = lambda path: F.get_json_object("payload", f"$.{path}")
    rows = events(_turn_frames(spark, d))
    return rows.select("turn_id", "seq", of("type").alias("type"), of("text").alias("text"), of("usage.totalTokenCount").cast("long").alias("total"), of("outputTokens").cast("long").alias("output"), of("error").alias("error"))


# usage, prices, quotas

_USAGE = f"""usage AS (SELECT conv_id, coalesce(sum({estimate_sql('text')}) FILTER (role = 'user'), 0)::BIGINT AS prompt, coalesce(sum({estimate_sql('text')}) FILTER (role = 'assistant'), 0)::BIGINT AS output,
  CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN 1 ELSE prompt + output END AS total FROM conversations GROUP BY conv_id)"""


def _usage(spark, d):
    cost = estimate(F.col("text"))
    of = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, cost)), F.lit(0))
    rows = T.table(spark, d, "conversations").groupBy("conv_id").agg(of("user").alias("prompt"), of("assistant").alias("candidates"), F.lit(None).cast("long").alias("thoughts"))
    total = F.when(F.col("conv_id") % 7 == 0, F.lit(None)).when(F.col("conv_id") % 5 == 0, 1).otherwise(F.col("prompt") + F.col("candidates"))
    return serve.accounted(rows.withColumn("total", total.cast("long")))


@query("usage_accounting", f"WITH {_USAGE} SELECT conv_id, prompt, output, total IS NULL OR total = prompt + output AS accounted FROM usage")
def usage_accounting(spark, d):
    return _usage(spark, d).select("conv_id", "prompt", "output", "accounted")


_RATES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in serve.RATES)


@query(
    "cost_projection",
    f"""WITH {_USAGE} SELECT conv_id, model, round(prompt * i / 1e6, 9) AS input_usd, round(output * o / 1e6, 9) AS output_usd, round(prompt * i / 1e6 + output * o / 1e6, 9) AS total_usd, i = 0 AND o = 0 AS free, model = '{serve.SERVING}' AS served
    FROM usage, (VALUES {_RATES}) r(model, i, o)""",
)
def cost_projection(spark, d):
    rows = serve.project(_usage(spark, d), spark.createDataFrame(serve.RATES, "model string, in_per_mtok double, out_per_mtok double"))
    return rows.select("conv_id", "model", *(F.round(c, 9).alias(c) for c in ("input_usd", "output_usd", "total_usd")), "free", "served")


@query(
    "quota_decisions",
    f"""WITH RECURSIVE h AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w(user_id, rn, event_id, opened, n) AS (
      SELECT user_id, rn, event_id, ts, 1::BIGINT FROM h WHERE rn = 1
      UNION ALL SELECT h.user_id, h.rn, h.event_id, CASE WHEN h.ts >= w.opened + INTERVAL {serve.WINDOW_SECONDS} SECOND THEN h.ts ELSE w.opened END,
                       CASE WHEN h.ts >= w.opened + INTERVAL {serve.WINDOW_SECONDS} SECOND THEN 1 ELSE w.n + 1 END FROM w JOIN h ON h.user_id = w.user_id AND h.rn = w.rn + 1)
    SELECT event_id, user_id, n, n <= {serve.LIMIT} AS allowed FROM w""",
)
def quota_decisions(spark, d):
    hits = T.table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").alias("hit_id"))
    return serve.quota(hits).select(F.col("hit_id").alias("event_id"), F.col("key").alias("user_id"), "n", "allowed")


@query(
    "global_cap",
    f"""WITH s AS (SELECT event_id, ts, round(value * 10)::BIGINT AS cents FROM events WHERE event_type = 'purchase'),
    b AS (SELECT event_id, cents, coalesce(sum(cents) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
    SELECT event_id, cents, before, before < {serve.CEILING_CENTS} AS allowed FROM b""",
)
def global_cap(spark, d):
    rows = T.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts", F.to_date("ts").alias("day"), F.round(F.col("value") * 10).cast("long").alias("cents"))
    return serve.global_cap(rows, "day", ["ts", "event_id"]).select("event_id", "cents", "before", "allowed")


_SHARES, _BATCHES = 8, 4


def _leases_sql() -> str:
    """Batch by batch: what is left, its leases, and what they have allowed."""
    out = ["purchases AS (SELECT event_id, ts, round(value * 10)::BIGINT AS cents, event_id % 4 AS batch, event_id % 8 AS share FROM events WHERE event_type = 'purchase')", "left0 AS (SELECT 50000::BIGINT AS cents)"]
    for b in range(_BATCHES):
        out.append(f"""b{b} AS (SELECT p.event_id, p.batch, p.cents, l.cents // {_SHARES} + (p.share < l.cents % {_SHARES})::BIGINT AS lease,
          coalesce(sum(p.cents) OVER (PARTITION BY p.share ORDER BY p.ts, p.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM purchases p, left{b} l WHERE p.batch = {b})""")
        out.append(f"left{b + 1} AS (SELECT greatest(0, (SELECT cents FROM left{b}) - coalesce(sum(cents) FILTER (before < lease), 0))::BIGINT AS cents FROM b{b})")
    rows = " UNION ALL ".join(f"SELECT * FROM b{b}" for b in range(_BATCHES))
    return f"WITH {', '.join(out)} SELECT event_id, batch, cents, lease, before < lease AS allowed FROM ({rows})"


@query("ceiling_leases", _leases_sql())
def ceiling_leases(spark, d):
    """Purchases in four batches against one ceiling, each batch by leases of what the ones before have left. Here shares go by the event's number, so that SQL can say them."""
    rows = T.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("turn_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 10).cast("long").alias("cents"))
    ledger = ceiling.Ledger(spark, f"{scratch(spark)}/ledger-{uuid.uuid4().hex[:12]}")
    for b in range(_BATCHES):
        ledger.settle(rows.where(F.col("turn_id") % _BATCHES == b), b, 50_000, _SHARES, share=(F.col("turn_id") % _SHARES).cast("int"))
    return ledger.decisions().select(F.col("turn_id").alias("event_id"), "batch", "cents", "lease", "allowed")


# structure


@query(
    "validate_graph",
    f"""WITH {T.SYMBOLS},{T.SUPPLY_EDGES}, raw AS (SELECT repo, src, dst, kind FROM supply_edges UNION ALL SELECT 'parts', 'p:1', 'p:1', 'N' UNION ALL SELECT 'parts', 'p:1', 'p:none', 'N')
    SELECT 'self-loop' AS violation, count(*) AS n FROM raw WHERE src = dst UNION ALL
    SELECT 'missing endpoint', count(*) FROM raw r WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = r.repo AND s.id = r.src) OR NOT EXISTS (SELECT 1 FROM symbols s WHERE s.repo = r.repo AND s.id = r.dst) UNION ALL
    SELECT 'repeated edge', count(*) FROM (SELECT 1 FROM raw GROUP BY repo, src, dst, kind HAVING count(*) > 1) UNION ALL
    SELECT 'repeated id', count(*) FROM (SELECT 1 FROM symbols GROUP BY repo, id HAVING count(*) > 1) UNION ALL
    SELECT 'rest without first line', count(*) FROM symbols WHERE doc_rest <> '' AND doc_first = ''""",
)
def validate_graph(spark, d):
    """Violations of the model's invariants, counted; uncollapsed edges and two planted ones have some."""
    from contextquarry.operators.validate import violations

    more = spark.createDataFrame([("parts", "p:1", "p:1", "N"), ("parts", "p:1", "p:none", "N")], "repo string, src string, dst string, kind string")
    return violations(T.symbols(spark, d), T.supply_edges(spark, d).unionByName(more))
