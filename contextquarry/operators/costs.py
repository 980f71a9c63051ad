"""Counted token costs: each different text is counted once, whatever runs come after."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextquarry.functions.text import TIERS, render
from contextquarry.scratch import materialize

#: Fixed value: the source of costs that were counted.
COUNTED = "count_tokens"
PARTS = ("signature", "doc_first", "doc_rest", "body")
#: (sha256, text) -> (sha256, tokens: long), null where a text couldn't be counted.
Counter = Callable[[DataFrame], DataFrame]


def by_expression(count: Callable[[Column], Column]) -> Counter:
    """A counter that is an expression of the text."""
    return lambda texts: texts.select("sha256", count(F.col("text")).cast("long").alias("tokens"))


def by_batches(count: Callable[[list[str]], list[int | None]]) -> Counter:
    """A counter that takes lists of texts, such as a tokenizer or a remote service."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = pa.array(count(batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), tokens], names=["sha256", "tokens"])

    return lambda texts: texts.select("sha256", "text").mapInArrow(run, "sha256 string, tokens long")


@dataclass(frozen=True)
class CountCache:
    """Counts by the SHA-256 of the text, below path: a table for each counter's name, which is only added to."""

    spark: SparkSession
    path: str
    counter: str

    @property
    def _table(self) -> str:
        return f"{self.path.rstrip('/')}/counter={self.counter}"

    def read(self) -> DataFrame:
        """sha256, tokens; a text that two runs have counted at once is there once."""
        try:
            stored = self.spark.read.schema("sha256 string, tokens long").parquet(self._table)
        except Exception as e:  # noqa: BLE001
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "sha256 string, tokens long")
        return stored.groupBy("sha256").agg(F.max("tokens").alias("tokens"))

    def add(self, counts: DataFrame) -> None:
        counts.where("tokens IS NOT NULL").select("sha256", "tokens").write.mode("append").parquet(self._table)


@dataclass
class Counted:
    """symbols: with tokens, null for every symbol of a repo of which a text couldn't be counted. repos: repo, tokens_counted, token_source, total_tokens. asked: the texts that were counted now (sha256, tokens)."""

    symbols: DataFrame
    repos: DataFrame
    asked: DataFrame


def _rendered(symbols: DataFrame) -> DataFrame:
    """repo, ord, tier, text, sha256: three rows per symbol."""
    tiers = F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), render(t, *map(F.col, PARTS)).alias("text")) for t in TIERS))).alias("t")
    return symbols.select("repo", "ord", tiers).select("repo", "ord", "t.*").withColumn("sha256", F.sha2("text", 256))


def count_tokens(symbols: DataFrame, cache: CountCache, counter: Counter) -> Counted:
    """Count the rendered tiers of symbols (repo, ord and PARTS).

    Only texts that the cache doesn't have are counted, each once, and what was counted is added to the cache, also where others fail; failures are asked
    again by the next run. A repo is counted as a whole or not at all.
    """
    rows = _rendered(symbols)
    new = rows.select("sha256", "text").join(cache.read().select("sha256"), "sha256", "left_anti")
    asked = materialize(counter(new.dropDuplicates(["sha256"])), "counted-texts")
    cache.add(asked)
    keys = materialize(rows.select("repo", "ord", "tier", "sha256").join(cache.read(), "sha256", "left"), "costs")
    of = lambda tier: F.max(F.when(F.col("tier") == tier, F.col("tokens"))).alias(tier)
    costs = keys.groupBy("repo", "ord").agg(*map(of, ("signature", "skeleton", "full"))).select("repo", "ord", F.struct("signature", "skeleton", "full").alias("tokens"))
    good = F.bool_and(F.col("tokens").isNotNull())
    total = F.sum(F.when(F.col("tier") == "full", F.col("tokens")))
    repos = keys.groupBy("repo").agg(good.alias("tokens_counted"), total.alias("_t"))
    repos = repos.select("repo", "tokens_counted", F.when(F.col("tokens_counted"), COUNTED).alias("token_source"), F.when(F.col("tokens_counted"), F.col("_t")).otherwise(0).cast("long").alias("total_tokens"))
    whole = costs.join(repos.where("tokens_counted").select("repo"), "repo", "left_semi")
    return Counted(symbols.drop("tokens").join(whole, ["repo", "ord"], "left"), repos, asked)
