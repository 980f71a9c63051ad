"""Secret scans: strong spans by pattern, weak ones by the parts of a credential that they complete."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.llm.common import materialize


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, its part in a credential, the least length of the match (or of group 2, if the pattern has it)
    patterns that a match must contain, and parts one of which a text with a match has (in small letters): other texts aren't searched. Matches are leftmost and don't overlap within a kind."""

    name: str
    pattern: str
    part: str
    least: int
    group: int = 0
    contains: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()


BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", 6, 2, (), ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Kind("access", r"AKIA[A-Z0-9]+", "identifier", 20, 0, (), ("akia",)),
    # runs of 24 and more are the runs that are long enough, without pieces of text between all others
    Kind("hex", r"[0-9a-f]{24,}", "secret", 24),
)
WEAK = (
    Kind("key", r"[A-Za-z0-9/+]{32,}", "secret", 32, 0, ("[a-z]", "[A-Z]", "[0-9]")),
    Kind("account", r"""((?i:user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", "identifier", 3, 2, (), ("user", "login", "account", "client", "access")),
    Kind("endpoint", r"(?:https?|s3|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/@%?#=&+-]+", "endpoint", 12, 0, (), ("://",)),
)
KINDS = (*BASE, *WEAK)
#: Code points between the starts of parts of one credential.
SCOPE = 256
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _spans(text: Column, pieces: Column, kind: Kind) -> Column:
    """The spans of a kind, from the pieces of the text between its matches: starts are running sums of lengths in code points."""
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tried = F.regexp_extract_all(text, pattern, F.lit(kind.group))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        good = F.length(x["g"]) >= kind.least
        for c in kind.contains:
            good = good & x["m"].rlike(c)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), found.alias("m"), tried.alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(pieces) > 1, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """The weak spans (_id, _h, span) with the parts that complete them within the scope.

    A secret needs an identifier, an identifier a secret, and an endpoint both. Parts are dealt to buckets of scope code points
    and a weak span asks its own bucket and both neighbours: an interval join whose buckets hold what scope code points can hold,
    and a semi join, so no pairs are made.
    """
    exploded = rows.where(F.size("weak") > 0).select("_id", "_h", F.explode(F.concat("base", "weak")).alias("span")).distinct()
    part = F.element_at(F.array(*(F.lit(k.part) for k in KINDS)), F.col("span.rank") + 1)
    parts = exploded.select("_id", "_h", "span", part.alias("part"))
    at = F.floor(F.col("span.start") / scope).cast("long")

    def having(asked: DataFrame, wanted: str) -> DataFrame:
        given = parts.where(F.col("part") == wanted).select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), F.col("span.start").alias("_at"), at.alias("_b"))
        asked = asked.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
        near = F.abs(F.col("span.start") - F.col("_at")) <= scope
        found = asked.join(given, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")) & (F.col("_bucket") == F.col("_b")) & near, "left_semi")
        return found.drop("_bucket").distinct()

    weak = parts.where(F.col("span.rank") >= len(BASE)).select("_id", "_h", "span", "part")
    secrets, identifiers = having(weak.where("part = 'secret'"), "identifier"), having(weak.where("part = 'identifier'"), "secret")
    endpoints = having(having(weak.where("part = 'endpoint'"), "identifier"), "secret")
    return secrets.unionByName(identifiers).unionByName(endpoints).select("_id", "_h", "span")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (array of kind, start, end).

    The kinds of BASE are always reported, those of WEAK if complementary parts are near. Null is the empty text, without spans.
    Repeated rows get the same result each, null ids stay null, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def pieces(kind: Kind) -> Column:
        whole = F.split("_text", kind.pattern)
        if not kind.hints:
            return whole
        hinted = reduce(lambda a, b: a | b, (F.contains(F.col("_small"), F.lit(h)) for h in kind.hints))
        return F.when(hinted, whole).otherwise(F.array().cast("array<string>"))

    cut = rows.withColumn("_small", F.lower("_text")).select("*", *(pieces(k).alias(f"_p_{k.name}") for k in KINDS))
    spans = cut.select(
        "_id",
        F.xxhash64("_text").alias("_h"),
        *(_spans(F.col("_text"), F.col(f"_p_{k.name}"), k).alias(f"_s_{k.name}") for k in KINDS),
    )
    spans = spans.select("_id", "_h", F.concat(*(f"_s_{k.name}" for k in BASE)).alias("base"), F.concat(*(f"_s_{k.name}" for k in WEAK)).alias("weak"))
    spans = materialize(spans, "secret-spans")
    linked = _linked(spans, scope).groupBy(F.col("_id").alias("_i"), F.col("_h").alias("_g")).agg(F.collect_list("span").alias("_linked"))
    joined = spans.join(linked, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    every = F.concat("base", F.coalesce("_linked", F.array().cast(SPAN)))
    counts = ((F.size("base") - F.size(F.array_remove(F.col("base.kind"), k.name))).cast("long").alias(f"n_{k.name}") for k in BASE)
    found = F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("_id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), found.alias("found"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def _kind_sql(rank: int, kind: Kind) -> str:
    pattern = "'" + kind.pattern.replace("'", "''") + "'"
    tests = "".join(f" AND regexp_matches(m, '{c}')" for c in kind.contains)
    return f"""
  SELECT doc_id, '{kind.name}' AS kind, {rank} AS r, '{kind.part}' AS part, (e - length(m))::BIGINT AS s, e::BIGINT AS e
  FROM (SELECT doc_id, m, g, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[:len(ms)]) AS p, unnest(range(len(ms))) AS i
              FROM (SELECT doc_id, string_split_regex(text, {pattern}) AS ps, regexp_extract_all(text, {pattern}) AS ms,
                           regexp_extract_all(text, {pattern}, {kind.group}) AS gs FROM documents WHERE text IS NOT NULL)))
  WHERE length(g) >= {kind.least}{tests}"""


OP4_SQL = f"""
WITH spans AS ({" UNION ALL ".join(_kind_sql(i, k) for i, k in enumerate(KINDS))}),
strong AS (SELECT doc_id, kind, r, s, e FROM spans WHERE r < {len(BASE)}),
linked AS (
  SELECT doc_id, kind, r, s, e FROM spans w WHERE r >= {len(BASE)}
  AND (part = 'identifier' OR EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = w.doc_id AND x.part = 'identifier' AND abs(x.s - w.s) <= {SCOPE}))
  AND (part = 'secret' OR EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = w.doc_id AND x.part = 'secret' AND abs(x.s - w.s) <= {SCOPE}))),
base AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM strong GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(v.spans, '') AS spans
FROM documents d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN every v ON v.doc_id = d.doc_id
"""
