"""BM25 over one or two fields, for many tasks at once, without exploding the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextquarry.functions.text import tokenize, tokens
from contextquarry.scratch import materialize

K1, B = 1.5, 0.75
NAME_WEIGHT, TEXT_WEIGHT = 3.0, 1.0

FIELDS = {
    "name": lambda: F.col("name"),
    "text": lambda: F.concat_ws(" ", "signature", "doc_first"),
    "single": lambda: F.concat_ws(" ", "name", "signature", "doc_first"),
}


def query_terms(tasks: dict[int, str]) -> tuple[list[str], dict[int, list[int]]]:
    """The different terms of all tasks, and each task's terms, repeated ones too, as places among them."""
    terms = list(dict.fromkeys(t for task in tasks.values() for t in tokenize(task)))
    at = {t: i for i, t in enumerate(terms)}
    return terms, {k: [at[t] for t in tokenize(task)] for k, task in tasks.items()}


def _counts(found: Column, wanted: Column) -> Column:
    return F.transform(wanted, lambda term: F.size(F.filter(found, lambda t: t == term)).cast("long"))


def frequencies(symbols: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Add len_<field> and tf_<field> (how often each term occurs): one pass, no shuffle. Only tokens that are terms are counted."""
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    for f in fields:
        symbols = symbols.withColumn(f"_t_{f}", tokens(FIELDS[f]()))
    for f in fields:
        asked = F.filter(f"_t_{f}", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
        symbols = symbols.withColumn(f"len_{f}", F.size(f"_t_{f}").cast("long")).withColumn(f"_q_{f}", asked)
    out = symbols
    for f in fields:
        out = out.withColumn(f"tf_{f}", _counts(F.col(f"_q_{f}"), wanted))
    return out.drop(*(f"_{x}_{f}" for f in fields for x in "tq"))


def statistics(counted: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Per repo: n documents, and by field the mean length and each term's number of documents. One row per repo."""
    cols = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        cols.append(F.avg(f"len_{f}").alias(f"avg_{f}"))
        df = [F.sum((F.get(f"tf_{f}", F.lit(i)) > 0).cast("long")) for i in range(len(terms))]
        cols.append((F.array(*df) if df else F.array().cast("array<bigint>")).alias(f"df_{f}"))
    return counted.groupBy("repo").agg(*cols)


def field_score(field: str, places: list[int]) -> Column:
    """The sum over the task's terms in their order; a repeated term counts again."""

    def term(i: int) -> Column:
        tf, df = F.get(f"tf_{field}", F.lit(i)), F.get(f"df_{field}", F.lit(i))
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        norm = tf + K1 * (1 - B + B * F.col(f"len_{field}") / F.greatest(F.col(f"avg_{field}"), F.lit(1.0)))
        return F.when(tf > 0, idf * (tf * (K1 + 1)) / norm).otherwise(0.0)

    return reduce(lambda a, b: a + b, map(term, places), F.lit(0.0))


def scores(symbols: DataFrame, tasks: dict[int, str], fielded: bool = True, keep: tuple[str, ...] = ("repo", "ord", "id"), repos: dict[int, str] | None = None) -> DataFrame:
    """request_id, the kept columns, name_score and text_score (or single_score), and score, for every symbol and task.

    repos: the repo of each task; its other symbols get no row. Without it all do. What is counted is written once, a few longs a
    row, and read for the statistics and for the scores. No tasks, no rows.
    """
    fields = ["name", "text"] if fielded else ["single"]
    terms, places = query_terms(tasks)
    counted = frequencies(symbols, terms, fields).select(*keep, *(f"{p}_{f}" for f in fields for p in ("len", "tf")))
    if tasks:
        counted = materialize(counted, "bm25-counted")
    joined = counted.join(statistics(counted, terms, fields).withColumnRenamed("repo", "_repo"), F.col("repo") == F.col("_repo")).drop("_repo")
    each = {k: F.struct(F.lit(k).cast("long").alias("request_id"), *(field_score(f, own).alias(f"{f}_score") for f in fields)) for k, own in places.items()}
    none = F.array().cast(f"array<struct<request_id:long,{','.join(f'{f}_score:double' for f in fields)}>>")
    if repos is None:
        asked = F.array(*each.values()) if each else none
    else:
        asked = none
        for repo in dict.fromkeys(repos[k] for k in each):
            asked = F.when(F.col("repo") == repo, F.array(*(x for k, x in each.items() if repos[k] == repo))).otherwise(asked)
    flat = joined.select(*keep, F.explode(asked).alias("s")).select(*keep, "s.*")
    total = NAME_WEIGHT * F.col("name_score") + TEXT_WEIGHT * F.col("text_score") if fielded else F.col("single_score")
    return flat.withColumn("score", total)


def scores_sql(fielded: bool = True) -> str:
    """CTEs up to bm25(request_id, repo, ord, id, [name_score, text_score,] score), from symbols and asked."""
    from contextquarry.functions.text import tokens_sql

    fields = {"name": "name", "text": "concat_ws(' ', signature, doc_first)"} if fielded else {"single": "concat_ws(' ', name, signature, doc_first)"}
    out = [f"terms AS (SELECT request_id, repo, unnest(ts) AS term, unnest(range(len(ts))) AS at FROM (SELECT request_id, repo, {tokens_sql('task')} AS ts FROM asked))"]
    for f, text in fields.items():
        out.append(f"""
toks_{f} AS (SELECT repo, ord, id, {tokens_sql(text)} AS ts FROM symbols),
stat_{f} AS (SELECT repo, count(*) AS n, avg(len(ts)) AS avgdl FROM toks_{f} GROUP BY repo),
tf_{f} AS (SELECT repo, ord, id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT repo, ord, id, ts, unnest(ts) AS term FROM toks_{f}) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df_{f} AS (SELECT repo, term, count(*) AS df FROM tf_{f} GROUP BY ALL),
score_{f} AS (
  SELECT q.request_id, t.repo, t.ord, t.id,
         sum(ln((s.n - d.df + 0.5) / (d.df + 0.5) + 1) * (t.tf * {K1 + 1}) / (t.tf + {K1} * (1 - {B} + {B} * t.dl / greatest(s.avgdl, 1.0))) ORDER BY q.at) AS score
  FROM terms q JOIN tf_{f} t ON t.repo = q.repo AND t.term = q.term JOIN df_{f} d ON d.repo = t.repo AND d.term = t.term JOIN stat_{f} s ON s.repo = t.repo
  GROUP BY ALL)""")
    if fielded:
        joins = "LEFT JOIN score_name a ON a.request_id = q.request_id AND a.id = s.id AND a.repo = s.repo LEFT JOIN score_text b ON b.request_id = q.request_id AND b.id = s.id AND b.repo = s.repo"
        cols = f"coalesce(a.score, 0) AS name_score, coalesce(b.score, 0) AS text_score, {NAME_WEIGHT} * coalesce(a.score, 0) + {TEXT_WEIGHT} * coalesce(b.score, 0) AS score"
    else:
        joins = "LEFT JOIN score_single a ON a.request_id = q.request_id AND a.id = s.id AND a.repo = s.repo"
        cols = "coalesce(a.score, 0) AS score"
    out.append(f"bm25 AS (SELECT q.request_id, s.repo, s.ord, s.id, {cols} FROM asked q JOIN symbols s ON s.repo = q.repo {joins})")
    return ",\n".join(out)
