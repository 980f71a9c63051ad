"""Queries of the model: symbols, ranking, expansion, packs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contextquarry.catalog import query
from contextquarry.functions.text import render, render_sql, tokens, tokens_sql
from contextquarry.operators import bm25, graph, packer, postings
from contextquarry.plans.pack import FUSE_SQL, fuse, pack, render_pack, scored
from contextquarry.scratch import scratch
from contextquarry.session import spread
from contextquarry.sources import tables as T

BASE = f"{T.SYMBOLS},{T.REQUESTS_SQL}"
EDGES = f"{T.SUPPLY_EDGES}, edges AS ({graph.collapse_sql('supply_edges')})"
RANKED = f"{BASE},{bm25.scores_sql()}"
EXPANDED = f"{RANKED},{EDGES},{graph.reached_sql(1)},{FUSE_SQL}"
PACKED = f"{EXPANDED},{packer.FILL_SQL}"
TASKS = {r[0]: r[2] for r in T.REQUESTS}


def _edges(spark, d):
    return graph.collapse(T.supply_edges(spark, d))


def _pack(spark, d):
    return pack(T.symbols(spark, d, True), _edges(spark, d), T.requests(spark, d))


# sources


@query("snapshot_scan", f"WITH {T.SYMBOLS} SELECT repo, ord, id, file, kind, name, signature, c_sig AS signature_tokens, c_skel AS skeleton_tokens, c_full AS full_tokens FROM symbols")
def snapshot_scan(spark, d):
    return T.symbols(spark, d).select("repo", "ord", "id", "file", "kind", "name", "signature", *(F.col(f"tokens.{t}").alias(f"{t}_tokens") for t in ("signature", "skeleton", "full")))


@query("catalog_names", f"WITH {T.SYMBOLS} SELECT DISTINCT repo FROM symbols WHERE regexp_full_match(repo, '[A-Za-z0-9_-]+') ORDER BY repo")
def catalog_names(spark, d):
    return T.symbols(spark, d).select("repo").where(F.col("repo").rlike(r"^[A-Za-z0-9_-]+$")).distinct().orderBy("repo")


CATALOG_NAMES = ["documents", "parts", "unreadable"]


@query(
    "repo_catalog",
    f"""WITH {T.SYMBOLS} SELECT n.repo, count(s.id) AS symbols, coalesce(sum(s.c_full), 0)::BIGINT AS total_tokens, CASE WHEN count(s.id) > 0 THEN 'estimate' END AS token_source
    FROM (VALUES {", ".join(f"('{n}')" for n in CATALOG_NAMES)}) n(repo) LEFT JOIN symbols s ON s.repo = n.repo GROUP BY n.repo""",
)
def repo_catalog(spark, d):
    names = spark.createDataFrame([(n,) for n in CATALOG_NAMES], "repo string")
    sums = T.symbols(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"), F.sum("tokens.full").alias("total_tokens"), F.lit("estimate").alias("token_source"))
    return names.join(sums, "repo", "left").select("repo", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"), "token_source")


@query("distinct_files", f"WITH {T.SYMBOLS} SELECT DISTINCT repo, file FROM symbols ORDER BY repo, file")
def distinct_files(spark, d):
    return T.symbols(spark, d).select("repo", "file").distinct().orderBy("repo", "file")


@query("tokenize", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return spread(T.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("render_tiers", f"WITH {T.DOCUMENT_SYMBOLS} SELECT id, sha256({render_sql('signature')}) AS signature, sha256({render_sql('skeleton')}) AS skeleton, sha256({render_sql('full')}) AS full_text FROM document_symbols")
def render_tiers(spark, d):
    parts = list(map(F.col, ("signature", "doc_first", "doc_rest", "body")))
    return T.document_symbols(spark, d).select("id", *(F.sha2(render(t, *parts), 256).alias(n) for t, n in (("signature", "signature"), ("skeleton", "skeleton"), ("full", "full_text"))))


@query(
    "symbol_ids",
    f"""WITH {T.SYMBOLS} SELECT repo, ord, file || '::' || name || CASE WHEN count(*) OVER (PARTITION BY repo, file, name) > 1 THEN '#' || ord ELSE '' END AS id,
    max(ord) OVER (PARTITION BY repo, file, name) = ord AS is_target FROM symbols""",
)
def symbol_ids(spark, d):
    """Ids by file and name, with the place appended to every member of a collision; edges go to the last member."""
    from pyspark.sql import Window

    same = Window.partitionBy("repo", "file", "name")
    base = F.concat_ws("::", "file", "name")
    many = F.count(F.lit(1)).over(same) > 1
    return T.symbols(spark, d).select("repo", "ord", F.when(many, F.concat(base, F.lit("#"), F.col("ord").cast("string"))).otherwise(base).alias("id"), (F.max("ord").over(same) == F.col("ord")).alias("is_target"))


# ranking


@query("bm25_stats", f"WITH {T.SYMBOLS} SELECT repo, count(*) AS n, round(avg(len({tokens_sql('name')})), 6) AS avg_name, round(avg(len({tokens_sql("concat_ws(' ', signature, doc_first)")})), 6) AS avg_text FROM symbols GROUP BY repo")
def bm25_stats(spark, d):
    counted = bm25.frequencies(T.symbols(spark, d, True), [], ["name", "text"])
    return bm25.statistics(counted, [], ["name", "text"]).select("repo", "n", F.round("avg_name", 6).alias("avg_name"), F.round("avg_text", 6).alias("avg_text"))


TERMS = bm25.query_terms(TASKS)[0]


@query(
    "bm25_df",
    f"""WITH {T.SYMBOLS}, t AS (SELECT repo, unnest(list_distinct({tokens_sql("concat_ws(' ', name, signature, doc_first)")})) AS term FROM symbols)
    SELECT r.repo, q.term, (SELECT count(*) FROM t WHERE t.repo = r.repo AND t.term = q.term) AS df
    FROM (SELECT DISTINCT repo FROM symbols) r, (SELECT unnest({TERMS!r}) AS term) q""",
)
def bm25_df(spark, d):
    counted = bm25.frequencies(T.symbols(spark, d, True), TERMS, ["single"])
    df = bm25.statistics(counted, TERMS, ["single"])
    return df.select("repo", F.explode(F.arrays_zip(F.array(*map(F.lit, TERMS)).alias("term"), F.col("df_single").alias("df"))).alias("x")).select("repo", "x.*")


@query(
    "bm25_tf",
    f"""WITH {T.SYMBOLS}, t AS (SELECT repo, id, unnest({tokens_sql("concat_ws(' ', name, signature, doc_first)")}) AS term FROM symbols)
    SELECT repo, id, term, count(*) AS tf FROM t WHERE term IN (SELECT unnest({TERMS!r})) GROUP BY ALL""",
)
def bm25_tf(spark, d):
    counted = bm25.frequencies(T.symbols(spark, d, True), TERMS, ["single"])
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, TERMS)).alias("term"), F.col("tf_single").alias("tf"))).alias("x")
    return counted.select("repo", "id", pairs).select("repo", "id", "x.*").where("tf > 0")


def _bm25(name, fielded, column):
    @query(name, f"WITH {BASE},{bm25.scores_sql(fielded)} SELECT request_id, id, round({column}, 6) AS score FROM bm25 WHERE {column} > 0")
    def run(spark, d):
        return scored(T.symbols(spark, d, True), T.requests(spark, d), fielded).where(F.col(column) > 0).select("request_id", "id", F.round(column, 6).alias("score"))


_bm25("bm25_name", True, "name_score")
_bm25("bm25_sig", True, "text_score")
_bm25("bm25_fielded", True, "score")
_bm25("bm25_single", False, "score")


@query("bm25_topk", f"WITH {RANKED},{EDGES},{graph.reached_sql(1)} SELECT request_id, seed AS id, seed_rank, round(seed_score, 6) AS score FROM seeds")
def bm25_topk(spark, d):
    return graph.top_seeds(scored(T.symbols(spark, d, True), T.requests(spark, d))).select("request_id", F.col("seed").alias("id"), F.col("seed_rank").cast("long").alias("seed_rank"), F.round("seed_score", 6).alias("score"))


def _stale(symbols):
    """An earlier state of symbols: some are missing, some say something else, and some have gone since."""
    kept = symbols.where(F.col("ord") % 5 != 0)
    changed = kept.withColumn("signature", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("the red secret_token of "), F.col("signature"))).otherwise(F.col("signature")))
    gone = symbols.where(F.col("ord") % 7 == 0).withColumns({"ord": F.col("ord") + F.lit(1 << 50), "id": F.concat(F.lit("gone:"), F.col("id"))})
    return changed.unionByName(gone)


def _index(spark, d):
    """An index of symbols that was built from an earlier state and then updated."""
    index = postings.Index(spark, f"{scratch(spark)}/index-{uuid.uuid4().hex[:12]}")
    symbols = T.symbols(spark, d, True)
    index.update(_stale(symbols))
    index.update(symbols)
    return index


@query("bm25_topk_index", f"WITH {RANKED},{EDGES},{graph.reached_sql(1)} SELECT request_id, seed AS id, seed_rank, round(seed_score, 6) AS score FROM seeds")
def bm25_topk_index(spark, d):
    """bm25_topk from a stored index, two generations old, that reads the blocks that can matter."""
    best = postings.top(_index(spark, d), T.requests(spark, d), graph.SEEDS)
    return best.select("request_id", "id", F.col("rank").alias("seed_rank"), F.round("score", 6).alias("score"))


@query(
    "index_statistics",
    f"""WITH {T.SYMBOLS}, n AS (SELECT repo, count(*) AS docs, round(avg(len({tokens_sql('name')})), 6) AS avg_name, round(avg(len({tokens_sql("concat_ws(' ', signature, doc_first)")})), 6) AS avg_text FROM symbols GROUP BY repo),
    w AS (SELECT repo, count(*) FILTER (ord % 5 = 0) AS added, count(*) FILTER (ord % 5 <> 0 AND ord % 3 = 0) AS changed, count(*) FILTER (ord % 7 = 0) AS gone FROM symbols GROUP BY repo)
    SELECT n.repo, docs, avg_name, avg_text, w.added + w.changed AS written, w.gone FROM n JOIN w ON w.repo = n.repo""",
)
def index_statistics(spark, d):
    """Documents and mean lengths of an index after an update, and how many documents the update has written and removed."""
    index = _index(spark, d)
    last = index.table("documents").where("gen = 2").groupBy("repo").agg(F.count("hash").alias("written"), F.count_if(F.col("hash").isNull()).alias("gone"))
    return index.averages().join(last, "repo").select("repo", "docs", F.round("avg_name", 6).alias("avg_name"), F.round("avg_text", 6).alias("avg_text"), "written", "gone")


# graph


@query("edge_collapse", f"WITH {T.TRANSITION_EDGES} {graph.collapse_sql('transition_edges')}")
def edge_collapse(spark, d):
    return graph.collapse(T.transition_edges(spark, d))


@query("supply_graph", f"WITH {T.SUPPLY_EDGES} {graph.collapse_sql('supply_edges')}")
def supply_graph(spark, d):
    return _edges(spark, d)


@query("edge_report", f"WITH {EDGES} SELECT kind, count(*) AS edges, count(*) FILTER (weight > 1) AS heavy, max(weight) AS max_weight, sum(weight)::BIGINT AS raw FROM edges GROUP BY kind")
def edge_report(spark, d):
    return _edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("weight") > 1).alias("heavy"), F.max("weight").alias("max_weight"), F.sum("weight").alias("raw"))


@query(
    "top_files",
    f"""WITH {T.SYMBOLS}, f AS (SELECT repo, file, sum(c_full)::BIGINT AS tokens, min(ord) AS first FROM symbols GROUP BY ALL)
    SELECT repo, file, tokens FROM f QUALIFY row_number() OVER (PARTITION BY repo ORDER BY tokens DESC, first) <= 5""",
)
def top_files(spark, d):
    """The five files with most tokens of each repo, ties by the file seen first."""
    from pyspark.sql import Window

    sums = T.symbols(spark, d).groupBy("repo", "file").agg(F.sum("tokens.full").alias("tokens"), F.min("ord").alias("first"))
    return sums.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("tokens"), "first"))).where("n <= 5").select("repo", "file", "tokens")


def _contrib(hops):
    @query(f"graph_contrib_d{hops}", f"WITH {RANKED},{EDGES},{graph.reached_sql(hops)} SELECT request_id, id, round(graph_score, 6) AS graph_score, hops, from_id FROM contrib")
    def run(spark, d):
        seeds = graph.top_seeds(scored(T.symbols(spark, d, True), T.requests(spark, d)))
        return graph.contributions(graph.reached(seeds, _edges(spark, d), hops)).select("request_id", "id", F.round("graph_score", 6).alias("graph_score"), "hops", "from_id")


for _h in (1, 2, 3):
    _contrib(_h)


@query("graph_contrib_heaviest", f"WITH {RANKED},{EDGES},{graph.reached_sql(2, first_edge=False)} SELECT request_id, id, round(graph_score, 6) AS graph_score, hops, from_id FROM contrib")
def graph_contrib_heaviest(spark, d):
    """Two hops, each by the heaviest edge of the hop instead of the first one met."""
    seeds = graph.top_seeds(scored(T.symbols(spark, d, True), T.requests(spark, d)))
    return graph.contributions(graph.reached(seeds, _edges(spark, d), 2, first_edge=False)).select("request_id", "id", F.round("graph_score", 6).alias("graph_score"), "hops", "from_id")

_DEPTHS = " UNION ALL ".join(
    f"""SELECT r.request_id, {h} AS depth, count(DISTINCT r.node) FILTER (s.seed IS NULL) AS recovered, count(DISTINCT r.node) AS n, (SELECT count(DISTINCT round(g, 4)) FROM
    (SELECT request_id, max(score) AS g FROM reached WHERE hop <= {h} GROUP BY request_id, node) v WHERE v.request_id = r.request_id) AS kinds
    FROM reached r LEFT JOIN seeds s ON s.request_id = r.request_id AND s.seed = r.node WHERE r.hop <= {h} GROUP BY r.request_id"""
    for h in (1, 2, 3)
)


#: All positive scores are seeds here, so the task names few symbols.
DEPTH_TASK = {1: "000000003 000000007 000000042"}
_DEPTH_ASKED = f"asked AS (SELECT 1::BIGINT AS request_id, 'parts' AS repo, '{DEPTH_TASK[1]}' AS task)"


@query(
    "hop_depth",
    f"""WITH {T.SYMBOLS},{_DEPTH_ASKED},{bm25.scores_sql()},{EDGES},{graph.reached_sql(3, None)}, depths AS ({_DEPTHS})
    SELECT request_id, depth::BIGINT AS depth, recovered, round(kinds / n, 6) AS spread, row_number() OVER (PARTITION BY request_id ORDER BY recovered DESC, depth) = 1 AND recovered > 0 AS best FROM depths""",
)
def hop_depth(spark, d):
    return graph.hop_depth(bm25.scores(T.part_symbols(spark, d), DEPTH_TASK), _edges(spark, d))


def _all_depths_sql() -> str:
    out = ["near AS (SELECT repo, node, next, max(w) AS w FROM (SELECT repo, src AS node, dst AS next, weight AS w FROM edges UNION ALL SELECT repo, dst, src, weight FROM edges) GROUP BY ALL)", "hop0 AS (SELECT request_id, repo, id AS seed, score AS seed_score, id AS node, 0::BIGINT AS w FROM bm25 WHERE score > 0)"]
    for h in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT request_id, seed, node FROM hop{k}" for k in range(h))
        out.append(f"""hop{h} AS (SELECT f.request_id, f.repo, f.seed, f.seed_score, n.next AS node, max(n.w) AS w FROM hop{h - 1} f JOIN near n ON n.repo = f.repo AND n.node = f.node
          ANTI JOIN ({seen}) v ON v.request_id = f.request_id AND v.seed = f.seed AND v.node = n.next GROUP BY ALL)""")
        out.append(f"best{h} AS (SELECT request_id, node, {h} AS hop, max(seed_score * pow({graph.DECAY}, {h}) * ln(1.0 + w)) AS v FROM hop{h} GROUP BY ALL)")
    depths = " UNION ALL ".join(
        f"""SELECT b.request_id, {h}::BIGINT AS depth, count(*) FILTER (s.node IS NULL) AS recovered, round(count(DISTINCT round(b.v, 4)) / count(*), 6) AS spread
        FROM (SELECT request_id, node, max(v) AS v FROM ({" UNION ALL ".join(f"SELECT * FROM best{k}" for k in range(1, h + 1))}) GROUP BY ALL) b LEFT JOIN hop0 s ON s.request_id = b.request_id AND s.node = b.node GROUP BY b.request_id"""
        for h in (1, 2, 3)
    )
    return f"WITH {RANKED},{EDGES},{','.join(out)}, depths AS ({depths}) SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY recovered DESC, depth) = 1 AND recovered > 0 AS best FROM depths"


@query("hop_depth_all", _all_depths_sql())
def hop_depth_all(spark, d):
    """Hop depths of all requests, whatever their number of seeds."""
    return graph.hop_depth_all(scored(T.symbols(spark, d, True), T.requests(spark, d)), _edges(spark, d))


# packs


@query("fused_scores", f"WITH {EXPANDED} SELECT request_id, id, round(final, 6) AS final, reason FROM fused WHERE final > 0")
def fused_scores(spark, d):
    scores = scored(T.symbols(spark, d, True), T.requests(spark, d))
    contrib = graph.contributions(graph.reached(graph.top_seeds(scores), _edges(spark, d), 1))
    return fuse(scores, contrib).where("final > 0").select("request_id", "id", F.round("final", 6).alias("final"), "reason")


@query("pack_selected", f"WITH RECURSIVE {PACKED} SELECT request_id, pos, id, tier, tokens, reason FROM selected")
def pack_selected(spark, d):
    return _pack(spark, d).selected.select("request_id", "pos", "id", "tier", "tokens", "reason")


@query("pack_evicted", f"WITH RECURSIVE {PACKED} SELECT request_id, id, tokens, reason FROM evicted")
def pack_evicted(spark, d):
    return _pack(spark, d).evicted


_PINS = "SELECT p.request_id, p.id, s.tier, coalesce(s.tokens, e.tokens) AS tokens, coalesce(s.reason, e.reason) AS reason FROM (SELECT DISTINCT request_id, id FROM pins) p LEFT JOIN selected s ON s.request_id = p.request_id AND s.id = p.id LEFT JOIN evicted e ON e.request_id = p.request_id AND e.id = p.id"


@query("pack_pins", f"WITH RECURSIVE {PACKED} {_PINS}")
def pack_pins(spark, d):
    """What became of each pin."""
    p = _pack(spark, d)
    pins = p.candidates.where("pin IS NOT NULL").select("request_id", "id")
    got = p.selected.select("request_id", "id", "tier", "tokens", "reason").unionByName(p.evicted.select("request_id", "id", F.lit(None).cast("string").alias("tier"), "tokens", "reason"))
    return pins.join(got, ["request_id", "id"])


@query(
    "pack_evicts",
    f"""WITH RECURSIVE {PACKED} SELECT e.request_id, e.id, EXISTS (SELECT 1 FROM selected s WHERE s.request_id = e.request_id AND s.id = e.id) AS selected,
    EXISTS (SELECT 1 FROM evicted s WHERE s.request_id = e.request_id AND s.id = e.id) AS evicted FROM evicts e""",
)
def pack_evicts(spark, d):
    """Ids that a request excludes are in neither list, unless they are pins."""
    p = _pack(spark, d)
    asked = T.requests(spark, d).select("request_id", F.explode("evicts").alias("id"))
    mark = lambda df, name: df.select("request_id", "id", F.lit(True).alias(name))
    rows = asked.join(mark(p.selected, "selected"), ["request_id", "id"], "left").join(mark(p.evicted, "evicted"), ["request_id", "id"], "left")
    return rows.select("request_id", "id", F.coalesce("selected", F.lit(False)).alias("selected"), F.coalesce("evicted", F.lit(False)).alias("evicted"))


_COSTED = "costed AS (SELECT s.*, f.c_sig, f.c_skel, f.c_full, f.file FROM selected s JOIN fused f ON f.request_id = s.request_id AND f.id = s.id)"
_TOTALS = f"""{_COSTED}, totals AS (
  SELECT a.request_id, coalesce(sum(c_sig), 0)::BIGINT AS signature, coalesce(sum(greatest(0, c_skel - c_sig)) FILTER (tier IN ('skeleton', 'full')), 0)::BIGINT AS doc,
         coalesce(sum(greatest(0, c_full - c_skel)) FILTER (tier = 'full'), 0)::BIGINT AS body, coalesce(sum(tokens), 0)::BIGINT AS total, floor(a.budget * {packer.RESERVE})::BIGINT AS budget
  FROM asked a LEFT JOIN costed c ON c.request_id = a.request_id GROUP BY a.request_id, a.budget)"""


@query("pack_totals", f"WITH RECURSIVE {PACKED},{_TOTALS} SELECT * FROM totals")
def pack_totals(spark, d):
    return _pack(spark, d).totals


@query("render_pack", f"""WITH RECURSIVE {PACKED} SELECT s.request_id, sha256(string_agg(CASE tier WHEN 'full' THEN {render_sql('full')} WHEN 'skeleton' THEN {render_sql('skeleton')} ELSE {render_sql('signature')} END, '' ORDER BY pos)) AS text_sha256
    FROM selected s JOIN asked a ON a.request_id = s.request_id JOIN symbols y ON y.repo = a.repo AND y.id = s.id GROUP BY s.request_id""")
def rendered(spark, d):
    texts = render_pack(_pack(spark, d).selected, T.symbols(spark, d), T.requests(spark, d))
    return texts.select("request_id", F.sha2("text", 256).alias("text_sha256"))


@query(
    "pack_by_file",
    f"WITH RECURSIVE {PACKED},{_COSTED} SELECT request_id, file, count(*) AS n, sum(tokens)::BIGINT AS tokens, string_agg(id, ' ' ORDER BY pos) AS ids FROM costed GROUP BY request_id, file",
)
def pack_by_file(spark, d):
    p = _pack(spark, d)
    rows = p.selected.join(T.symbols(spark, d).join(T.requests(spark, d).select("request_id", "repo"), "repo").select("request_id", "id", "file"), ["request_id", "id"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), " ")
    return rows.groupBy("request_id", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), ids.alias("ids"))


@query(
    "pack_flags",
    f"""WITH RECURSIVE {PACKED},{_TOTALS}
    SELECT t.request_id, t.total < 0.5 * t.budget AS not_binding, count(c.id) FILTER (c.tier = 'full') AS at_full, count(c.id) FILTER (starts_with(c.reason, 'kept (degraded')) AS degraded,
           CASE WHEN t.total > 0 THEN round(100.0 * t.signature / t.total, 6) ELSE 0 END AS signature_pct, CASE WHEN t.total > 0 THEN round(100.0 * t.body / t.total, 6) ELSE 0 END AS body_pct
    FROM totals t LEFT JOIN costed c ON c.request_id = t.request_id GROUP BY ALL""",
)
def pack_flags(spark, d):
    p = _pack(spark, d)
    counts = p.selected.groupBy("request_id").agg(F.count_if(F.col("tier") == "full").alias("at_full"), F.count_if(F.col("reason").startswith("kept (degraded")).alias("degraded"))
    share = lambda c: F.when(F.col("total") > 0, F.round(100.0 * F.col(c) / F.col("total"), 6)).otherwise(0.0)
    rows = p.totals.join(counts, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("request_id", (F.col("total") < 0.5 * F.col("budget")).alias("not_binding"), zero("at_full"), zero("degraded"), share("signature").alias("signature_pct"), share("body").alias("body_pct"))
