"""The relations of the model, bound to tables at hand, with their DuckDB twins.

symbols: repo, ord, id, file, kind, name, signature, doc_first, doc_rest, body, tokens (struct of costs, null if uncounted)
edges: repo, src, dst, kind, weight          requests: request_id, repo, task, budget, pins, evicts
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextquarry.functions.text import estimate_sql, render_sql, with_costs
from contextquarry.session import spread, table

#: request_id, repo, task, budget, ords that are pinned, ords that are excluded
REQUESTS = [
    (1, "documents", "the and of tion", 4000, [], []),
    (2, "documents", "worthless idiot", 8000, [3, 5], [7]),
    (3, "documents", "License Apache version", 16000, [11, 2, 3], [2, 9]),
    (4, "documents", "secret_token password", 32000, [], [1]),
    (5, "documents", "The thereHe est_thing", 4000, [0, 1, 2, 4, 6, 8, 10, 12, 13, 14, 15, 16], []),
    (6, "parts", "red widget", 4000, [], []),
    (7, "parts", "small ring PROMO red", 8000, [5], [6]),
]


def document_symbols(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Texts as symbols: the first line is the signature, the second the documentation, the rest the body. spread_out: deal a scan of few partitions to all cores first."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    first = F.element_at(lines, 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = (spread(docs) if spread_out else docs).select(
        F.lit("documents").alias("repo"),
        F.col("doc_id").alias("ord"),
        F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("file"),
        F.col("lang").alias("kind"),
        F.regexp_extract(first, r"^[^ ]+(?: [^ ]+)?", 0).alias("name"),
        first.alias("signature"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("doc_first"),
        F.lit("").alias("doc_rest"),
        F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n").alias("body"),
    )
    return with_costs(rows)


DOCUMENT_SYMBOLS = f"""
document_lines AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
document_parts AS (
  SELECT 'documents' AS repo, doc_id AS ord, source || '::' || doc_id AS id, source AS file, lang AS kind, regexp_extract(ls[1], '^[^ ]+(?: [^ ]+)?') AS name,
         ls[1] AS signature, coalesce(ls[2], '') AS doc_first, '' AS doc_rest, array_to_string(ls[3:], chr(10)) AS body FROM document_lines),
document_symbols AS (
  SELECT *, {estimate_sql(render_sql("signature"))} AS c_sig, {estimate_sql(render_sql("skeleton"))} AS c_skel, {estimate_sql(render_sql("full"))} AS c_full
  FROM document_parts)"""


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, then suppliers, as the symbols of a graph."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.lit("p").alias("of"), F.col("p_brand").alias("file"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("signature")
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.lit("s").alias("of"), F.lit("suppliers").alias("file"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("signature")
    )
    rows = part.unionByName(supplier)
    # suppliers start far above the parts
    order = F.when(F.col("of") == "p", F.col("key")).otherwise(F.col("key") + F.lit(1 << 40))
    rows = rows.select(F.lit("parts").alias("repo"), order.alias("ord"), F.concat_ws(":", "of", F.col("key").cast("string")).alias("id"), "file", "kind", "name", "signature", *(F.lit("").alias(c) for c in ("doc_first", "doc_rest", "body")))
    return with_costs(rows)


PART_SYMBOLS = f"""
part_rows AS (
  SELECT 'parts' AS repo, p_partkey AS ord, 'p:' || p_partkey AS id, p_brand AS file, 'part' AS kind, p_name AS name, p_type || ' ' || p_brand AS signature FROM part
  UNION ALL SELECT 'parts', s_suppkey + (1::BIGINT << 40), 's:' || s_suppkey, 'suppliers', 'supplier', s_name, 'nation ' || s_nationkey FROM supplier),
part_symbols AS (
  SELECT *, {estimate_sql(render_sql("signature"))} AS c_sig, {estimate_sql(render_sql("skeleton"))} AS c_skel, {estimate_sql(render_sql("full"))} AS c_full
  FROM (SELECT *, '' AS doc_first, '' AS doc_rest, '' AS body FROM part_rows))"""


def symbols(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    return document_symbols(spark, sf_dir, spread_out).unionByName(part_symbols(spark, sf_dir))


SYMBOLS = f"""{DOCUMENT_SYMBOLS},{PART_SYMBOLS},
symbols AS (SELECT * FROM document_symbols UNION ALL BY NAME SELECT * FROM part_symbols)"""


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who supplied what, a row per order line: edges before they are collapsed."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("parts").alias("repo"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"), F.col("l_returnflag").alias("kind")
    )


SUPPLY_EDGES = "supply_edges AS (SELECT 'parts' AS repo, 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_returnflag AS kind FROM lineitem)"


def transition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event of a user to the next, with self-loops."""
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("repo"), F.lag("event_type").over(by).alias("src"), F.col("event_type").alias("dst"), F.lit("next").alias("kind"))
    return rows.where("src IS NOT NULL")


TRANSITION_EDGES = """transition_edges AS (
  SELECT * FROM (SELECT 'events' AS repo, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst, 'next' AS kind FROM events)
  WHERE src IS NOT NULL)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQUESTS with pins and evicts as ids, in their order; pins without doubles."""
    rows = spark.createDataFrame(REQUESTS, "request_id long, repo string, task string, budget long, pin_ords array<long>, evict_ords array<long>")
    of = symbols(spark, sf_dir).select("repo", F.col("ord").alias("_ord"), "id")

    def resolved(name: str, out: str) -> DataFrame:
        asked = rows.select("request_id", "repo", F.posexplode(name).alias("_at", "_ord")).join(of, ["repo", "_ord"])
        return asked.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias(out))

    out = rows.join(resolved("pin_ords", "pins"), "request_id", "left").join(resolved("evict_ords", "evicts"), "request_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("request_id", "repo", "task", "budget", F.coalesce("pins", empty).alias("pins"), F.coalesce("evicts", empty).alias("evicts"))


def _list_sql(values: list[int]) -> str:
    return f"{values}::BIGINT[]"


REQUESTS_SQL = f"""
asked AS (SELECT * FROM (VALUES {", ".join(f"({i}::BIGINT, '{r}', '{t}', {b}::BIGINT, {_list_sql(p)}, {_list_sql(e)})" for i, r, t, b, p, e in REQUESTS)})
          AS t(request_id, repo, task, budget, pin_ords, evict_ords)),
pins AS (SELECT a.request_id, s.id, a.place FROM (SELECT request_id, repo, unnest(pin_ords) AS ord, unnest(range(len(pin_ords))) AS place FROM asked) a JOIN symbols s ON s.repo = a.repo AND s.ord = a.ord),
evicts AS (SELECT a.request_id, s.id FROM (SELECT request_id, repo, unnest(evict_ords) AS ord FROM asked) a JOIN symbols s ON s.repo = a.repo AND s.ord = a.ord)"""
