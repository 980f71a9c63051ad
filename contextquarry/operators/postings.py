"""A stored inverted index for BM25: postings in blocks of places, updated for what has changed, and searched for many tasks in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextquarry.functions.text import tokens
from contextquarry.operators.bm25 import FIELDS, K1, NAME_WEIGHT, TEXT_WEIGHT, B
from contextquarry.scratch import materialize

#: Places (ord) of a block.
WIDTH = 1024
TABLES = {
    "documents": "repo string, ord bigint, id string, hash bigint, len struct<name:bigint,text:bigint>, terms array<struct<field:string,term:string>>",
    "statistics": "repo string, n bigint, name bigint, text bigint",
    "postings": "repo string, field string, term string, block bigint, n bigint, max_tf bigint, its_len bigint, min_len bigint, entries array<struct<ord:bigint,tf:bigint,len:bigint>>",
    "removed": "repo string, field string, term string, block bigint, ord bigint, of_gen bigint",
}
WEIGHTS = {"name": NAME_WEIGHT, "text": TEXT_WEIGHT}


def _part(tf: Column, length: Column, average: Column) -> Column:
    """What a term adds for its idf: it grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.greatest(average, F.lit(1.0))))


def _terms_of(field: str) -> Column:
    return F.transform(F.array_distinct(field), lambda term: F.struct(F.lit(field).alias("field"), term.alias("term")))


@dataclass(frozen=True)
class Index:
    """The tables below path, in generations: each update writes one, and a row in the log last; what isn't in the log isn't read.

    documents: what is indexed, with its terms; of the rows of one (repo, ord) the latest generation holds, and one without terms and lengths is gone. statistics: what a generation adds to a repo's documents and
    lengths. postings: by repo, field, term and block of WIDTH places, with what bounds a block's scores. removed: postings of earlier generations that no longer hold.
    """

    spark: SparkSession
    path: str

    def generations(self) -> list[int]:
        """Committed generations, a number each."""
        try:
            return sorted(r[0] for r in self.spark.read.schema("gen bigint").parquet(f"{self.path}/log").collect())
        except Exception as e:  # noqa: BLE001
            if getattr(e, "getCondition", lambda: "")() != "PATH_NOT_FOUND":
                raise
            return []

    def table(self, name: str) -> DataFrame:
        """A table with the column gen. Without any generation it is empty."""
        gens = self.generations()
        schema = f"{TABLES[name]}, gen bigint"
        if not gens:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("gen").isin(gens))

    def live(self, *columns: str) -> DataFrame:
        """repo, ord, gen and columns of the documents that hold, with the generation of each."""
        latest = F.max_by(F.struct(*dict.fromkeys(("hash", "gen", *columns))), "gen").alias("d")
        return self.table("documents").groupBy("repo", "ord").agg(latest).where("d.hash IS NOT NULL").select("repo", "ord", "d.gen", *(f"d.{c}" for c in columns))

    def update(self, symbols: DataFrame, whole: bool = True) -> int:
        """Index symbols (repo, ord, id, name, signature, doc_first) and return the number of the generation. With whole, what is indexed and not among them is removed.

        Only documents whose fields have changed are tokenized again; of others the hash is compared.
        """
        gens = self.generations()
        gen = gens[-1] + 1 if gens else 1
        texts = {f: F.coalesce(FIELDS[f](), F.lit("")) for f in WEIGHTS}
        given = symbols.select("repo", "ord", "id", *(t.alias(f) for f, t in texts.items())).withColumn("hash", F.xxhash64("id", *WEIGHTS))
        held = materialize(self.live("hash"), "index-live")
        old = held.withColumnsRenamed({"repo": "_r", "ord": "_o", "hash": "_h", "gen": "_g"})
        met = given.join(old, (F.col("repo") == F.col("_r")) & (F.col("ord") == F.col("_o")), "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("hash")))
        cut = met.select("repo", "ord", "id", "hash", *(tokens(F.col(f)).alias(f) for f in WEIGHTS))
        new = materialize(cut.select("repo", "ord", "id", "hash", F.struct(*(F.size(f).cast("long").alias(f) for f in WEIGHTS)).alias("len"), *WEIGHTS), "index-new")
        gone = held.join(given.select("repo", "ord"), ["repo", "ord"], "left_anti") if whole else held.limit(0)
        gone = materialize(gone.select("repo", "ord"), "index-gone")

        terms = F.concat(*(_terms_of(f) for f in WEIGHTS))
        none = [F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("hash", "bigint"), ("len", "struct<name:bigint,text:bigint>"), ("terms", "array<struct<field:string,term:string>>"))]
        self._write("documents", gen, new.select("repo", "ord", "id", "hash", "len", terms.alias("terms")).unionByName(gone.select("repo", "ord", *none)))

        touched = new.select("repo", "ord").unionByName(gone)
        replaced = self.live("len", "terms").join(touched, ["repo", "ord"], "left_semi")
        replaced = materialize(replaced.select("repo", "ord", "len", "terms", F.col("gen").alias("of_gen")), "index-replaced")
        block = F.floor(F.col("ord") / WIDTH).cast("long")
        dead = replaced.select("repo", "ord", "of_gen", F.explode("terms").alias("t")).select("repo", "t.field", "t.term", block.alias("block"), "ord", "of_gen")
        self._write("removed", gen, dead)
        sums = lambda df, sign: df.select("repo", F.lit(sign).cast("long").alias("n"), *((F.col(f"len.{f}") * sign).alias(f) for f in WEIGHTS))
        self._write("statistics", gen, sums(new, 1).unionByName(sums(replaced, -1)).groupBy("repo").agg(*(F.sum(c).alias(c) for c in ("n", *WEIGHTS))))

        fields = [new.select("repo", "ord", F.lit(f).alias("field"), F.col(f"len.{f}").alias("len"), F.explode(f).alias("term")) for f in WEIGHTS]
        counted = reduce(DataFrame.unionByName, fields).groupBy("repo", "field", "term", "ord", "len").agg(F.count(F.lit(1)).alias("tf")).withColumn("block", block)
        entries = F.array_sort(F.collect_list(F.struct("ord", "tf", "len"))).alias("entries")
        peak = F.max(F.struct("tf", (-F.col("len")).alias("l")))
        blocks = counted.groupBy("repo", "field", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), (-peak["l"]).alias("its_len"), F.min("len").alias("min_len"), entries)
        self._write("postings", gen, blocks.sortWithinPartitions("repo", "term", "field", "block"))
        self.spark.createDataFrame([(gen,)], "gen bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return gen

    def _write(self, name: str, gen: int, rows: DataFrame) -> None:
        columns = [x.split()[0] for x in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/gen={gen}")

    def averages(self) -> DataFrame:
        """repo, docs, avg_name, avg_text."""
        sums = self.table("statistics").groupBy("repo").agg(*(F.sum(c).alias(c) for c in ("n", *WEIGHTS)))
        return sums.where("n > 0").select("repo", F.col("n").alias("docs"), *((F.col(f) / F.col("n")).alias(f"avg_{f}") for f in WEIGHTS))


def query_terms(requests: DataFrame) -> DataFrame:
    """request_id, repo, term, ats: the places of each term of a task; a repeated term counts again."""
    each = requests.select("request_id", "repo", F.posexplode(tokens(F.col("task"))).alias("at", "term"))
    return each.groupBy("request_id", "repo", "term").agg(F.array_sort(F.collect_list("at")).alias("ats"))


@dataclass
class _Asked:
    """What a search reads before entries: the terms of requests, postings of them that no longer hold, and what a term counts."""

    terms: DataFrame
    dead: DataFrame
    weighed: DataFrame
    blocks: DataFrame


_KEY = ["repo", "field", "term"]


def _search(index: Index, requests: DataFrame, k: int) -> _Asked:
    asked = materialize(query_terms(requests), "index-terms")
    wanted = asked.select("repo", "term").distinct()
    head = index.table("postings").select(*_KEY, "block", "n", "max_tf", "its_len", "min_len", "gen")
    head = materialize(head.join(wanted, ["repo", "term"]), "index-heads")
    dead = materialize(index.table("removed").select(*_KEY, "block", "ord", F.col("of_gen").alias("gen_of")).join(wanted, ["repo", "term"]), "index-dead")
    df = head.select(*_KEY, "n").unionByName(dead.select(*_KEY, F.lit(-1).cast("long").alias("n"))).groupBy(*_KEY).agg(F.sum("n").alias("df")).where("df > 0")
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    of = lambda a, b: F.when(F.col("field") == "name", a).otherwise(b)
    weighed = df.join(index.averages(), "repo").select(*_KEY, idf.alias("idf"), of(F.col("avg_name"), F.col("avg_text")).alias("average"), of(F.lit(NAME_WEIGHT), F.lit(TEXT_WEIGHT)).alias("weight"))
    weighed = materialize(weighed, "index-idf")

    # a block with entries that no longer hold may have lost its best one
    stale = dead.select(*_KEY, "block", F.col("gen_of").alias("gen")).distinct().withColumn("_stale", F.lit(True))
    bounds = head.join(weighed, _KEY).join(stale, [*_KEY, "block", "gen"], "left").join(asked, ["repo", "term"])
    times = F.col("weight") * F.size("ats") * F.col("idf")
    most = times * _part(F.col("max_tf"), F.col("min_len"), F.col("average"))
    least = F.when(F.col("_stale"), 0.0).otherwise(times * _part(F.col("max_tf"), F.col("its_len"), F.col("average")))
    by_term = bounds.groupBy("request_id", "repo", "block", "field", "term").agg(F.max(most).alias("most"), F.max(least).alias("least"))
    blocks = materialize(by_term.groupBy("request_id", "repo", "block").agg(F.sum("most").alias("most"), F.max("least").alias("least")), "index-bounds")
    ranked = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("least")))).where(F.col("_n") <= k)
    # the least score that k blocks are certain of; sums may differ in their last places
    certain = ranked.groupBy(F.col("request_id").alias("_q")).agg(F.when(F.count(F.lit(1)) == k, F.min("least") * (1 - 1e-9)).otherwise(0.0).alias("certain"))
    kept = blocks.join(certain, F.col("request_id") == F.col("_q")).where(F.col("most") >= F.col("certain")).select("request_id", "repo", "block")
    return _Asked(asked, dead, weighed, kept)


def blocks_of(index: Index, requests: DataFrame, k: int) -> DataFrame:
    """request_id, repo, block: the blocks that top reads the entries of."""
    return _search(index, requests, k).blocks


def top(index: Index, requests: DataFrame, k: int) -> DataFrame:
    """request_id, repo, ord, id, score, rank: the k best positive scores of each request (request_id, repo, task), ties by ord; what bm25.scores gives of all symbols.

    Requests are a table, so the plan doesn't grow with them. First only the bounds of blocks are read: a block's best document scores what its best entry of one term adds at least, and the sum over all
    terms of what their greatest tf and least length would add at most. Blocks whose greatest possible score is below the k-th of the scores that blocks are certain of can't have any of the k best; only others'
    entries are read and scored in full.
    """
    asked = _search(index, requests, k)
    pairs = asked.blocks.join(asked.terms, ["request_id", "repo"]).select("request_id", "repo", "block", "term", "ats")
    found = index.table("postings").select(*_KEY, "block", "gen", "entries").join(pairs, ["repo", "term", "block"]).join(asked.weighed, _KEY)
    entries = found.select("request_id", *_KEY, "ats", "idf", "average", "gen", F.explode("entries").alias("e")).select("request_id", *_KEY, "ats", "idf", "average", "gen", "e.*")
    entries = entries.join(asked.dead.select(*_KEY, "ord", F.col("gen_of").alias("gen")), [*_KEY, "ord", "gen"], "left_anti")
    added = entries.select("request_id", "repo", "ord", "field", F.explode("ats").alias("at"), (F.col("idf") * _part(F.col("tf"), F.col("len"), F.col("average"))).alias("x"))
    # in the order of the task, so that equal documents have equal sums
    scored = added.groupBy("request_id", "repo", "ord").agg(F.array_sort(F.collect_list(F.struct("field", "at", "x"))).alias("xs"))
    total = lambda f: F.aggregate(F.filter("xs", lambda x: x["field"] == f), F.lit(0.0), lambda s, x: s + x["x"])
    scores = scored.select("request_id", "repo", "ord", (NAME_WEIGHT * total("name") + TEXT_WEIGHT * total("text")).alias("score")).where("score > 0")
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "ord")).cast("long")).where(F.col("rank") <= k)
    return best.join(index.live("id").select("repo", "ord", "id"), ["repo", "ord"]).select("request_id", "repo", "ord", "id", "score", "rank")
