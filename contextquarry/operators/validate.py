"""Invariants of symbols and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """violation, n: self-loops, edges with an end that is no symbol, repeated (src, dst, kind), repeated ids, documentation rest without a first line."""
    ids = symbols.select("repo", "id").distinct().withColumn("_s", F.lit(True))
    end = lambda df, c: df.join(ids.select("repo", F.col("id").alias(c), F.col("_s").alias(f"_{c}")), ["repo", c], "left")
    ends = end(end(edges, "src"), "dst")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
    many = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    found = [
        count(edges.where("src = dst"), "self-loop"),
        count(ends.where("_src IS NULL OR _dst IS NULL"), "missing endpoint"),
        count(many(edges, "repo", "src", "dst", "kind"), "repeated edge"),
        count(many(symbols, "repo", "id"), "repeated id"),
        count(symbols.where("doc_rest <> '' AND doc_first = ''"), "rest without first line"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: What facts are columns of; see check_facts.
FACT = "fact_id long, repo string, fact string, kind string, source string, target string, least long"


def check_facts(symbols: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """fact_id, ok, found, nearest: which of the facts (FACT) hold of symbols (repo, name, file) and collapsed edges (repo, src, dst, kind, weight), and what comes nearest to those that don't.

    edge: source has an edge of the kind to target, of weight `least` at least; found: its weight; nearest: the target of source's heaviest other edge of the kind.
    name: symbols named source lie in the file target, `least` at least; found: how many; nearest: the file with most others.
    count: there are `least` edges of the kind at least; found: how many.
    absent: no edge of the kind leads to target; found: how many do; nearest: the source of the heaviest.
    A null kind means all kinds. A fact of another name is an error of the job.
    """
    spelled = facts.withColumn("fact", F.when(F.col("fact").isin("edge", "name", "count", "absent"), F.col("fact")).otherwise(F.raise_error(F.concat(F.lit("no such fact: "), F.coalesce("fact", F.lit("null"))))))
    own = lambda fact: spelled.where(F.col("fact") == fact)
    of_kind = F.col("_kind").isNull() | (F.col("_kind") == F.col("kind"))
    weighed = edges.select("repo", "src", "dst", "kind", "weight")
    asked = lambda fact, **by: own(fact).select("fact_id", "repo", F.col("kind").alias("_kind"), F.col("least"), *(F.col(c).alias(n) for n, c in by.items()))
    # kinds of one pair of ends are one edge for a fact of all kinds
    met = asked("edge", src="source", target="target").join(weighed, ["repo", "src"]).where(of_kind).groupBy("fact_id", "target", "dst").agg(F.sum("weight").alias("w"))
    there, elsewhere = F.col("dst") == F.col("target"), F.col("dst") != F.col("target")
    edge = met.groupBy("fact_id").agg(F.max(F.when(there, F.col("w"))).alias("found"), F.max_by("dst", F.when(elsewhere, F.struct("w", "dst"))).alias("nearest"))
    met = asked("name", name="source", target="target").join(symbols.select("repo", "name", "file"), ["repo", "name"]).groupBy("fact_id", "target", "file").agg(F.count(F.lit(1)).alias("n"))
    here, other = F.col("file") == F.col("target"), F.col("file") != F.col("target")
    name = met.groupBy("fact_id").agg(F.max(F.when(here, F.col("n"))).alias("found"), F.max_by("file", F.when(other, F.struct("n", "file"))).alias("nearest"))
    kinds = weighed.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    count = asked("count").join(kinds, "repo").where(of_kind).groupBy("fact_id").agg(F.sum("n").alias("found"), F.lit(None).cast("string").alias("nearest"))
    into = asked("absent", dst="target").join(weighed, ["repo", "dst"]).where(of_kind)
    absent = into.groupBy("fact_id").agg(F.count(F.lit(1)).alias("found"), F.max_by("src", F.struct("weight", "src")).alias("nearest"))
    found = edge.unionByName(name).unionByName(count).unionByName(absent)
    n = F.coalesce("found", F.lit(0)).cast("long")
    ok = F.when(F.col("fact") == "absent", n == 0).otherwise(n >= F.greatest(F.lit(1), F.coalesce("least", F.lit(1))))
    return spelled.join(found, "fact_id", "left").select("fact_id", ok.alias("ok"), n.alias("found"), F.when(~ok, F.col("nearest")).alias("nearest"))
