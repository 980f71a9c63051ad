"""Stored indexes: four tables in versions, of which a pointer says which ones hold, and the JSON documents that they are exchanged as."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKENS = "struct<signature:bigint,skeleton:bigint,full:bigint>"
TABLES = {
    "snapshots": "repo string, commit string, built_at string, total_tokens bigint, tokens_counted boolean, token_source string",
    "symbols": f"repo string, ord bigint, id string, file string, kind string, name string, qualname string, line_start bigint, line_end bigint, signature string, doc_first string, doc_rest string, body string, tokens {_TOKENS}",
    "edges": "repo string, src string, dst string, kind string, weight bigint",
    "files": "repo string, path string, content string",
}
#: The names of a document's fields.
DOCUMENT = (
    "repo string, commit string, builtAt string, totalTokens bigint, tokensCounted boolean, tokenSource string, "
    f"symbols array<struct<id:string,file:string,kind:string,name:string,qualname:string,lineStart:bigint,lineEnd:bigint,signature:string,docFirstLine:string,docRest:string,body:string,tokens:{_TOKENS}>>, "
    "edges array<struct<`from`:string,`to`:string,kind:string,weight:bigint>>, files map<string,string>"
)
_SYMBOL = {"id": "id", "file": "file", "kind": "kind", "name": "name", "qualname": "qualname", "lineStart": "line_start", "lineEnd": "line_end", "signature": "signature", "docFirstLine": "doc_first", "docRest": "doc_rest", "body": "body", "tokens": "tokens"}


@dataclass
class Snapshot:
    """What is stored of some repos, a table each; see TABLES."""

    snapshots: DataFrame
    symbols: DataFrame
    edges: DataFrame
    files: DataFrame


def read_documents(spark: SparkSession, path: str) -> Snapshot:
    """The tables of JSON documents, one per repo and file. A symbol's order is its place in the document."""
    docs = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    meta = docs.select("repo", "commit", F.col("builtAt").alias("built_at"), F.col("totalTokens").alias("total_tokens"), F.col("tokensCounted").alias("tokens_counted"), F.col("tokenSource").alias("token_source"))
    symbols = docs.select("repo", F.posexplode("symbols").alias("at", "s")).select("repo", F.col("at").cast("long").alias("ord"), *(F.col(f"s.{a}").alias(b) for a, b in _SYMBOL.items()))
    edges = docs.select("repo", F.explode("edges").alias("e")).select("repo", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.weight")
    return Snapshot(meta, symbols, edges, docs.select("repo", F.explode("files").alias("path", "content")))


def write_documents(snapshot: Snapshot, path: str) -> None:
    """JSON documents, a line and a file part per repo: a repo is what fits a document, so it is collected into one row."""
    of = lambda df, name, item: df.groupBy("repo").agg(F.array_sort(F.collect_list(item)).alias(name))
    symbol = F.struct("ord", *(F.col(b).alias(a) for a, b in _SYMBOL.items()))
    symbols = of(snapshot.symbols, "symbols", symbol).withColumn("symbols", F.transform("symbols", lambda s: F.struct(*(s[a].alias(a) for a in _SYMBOL))))
    edges = of(snapshot.edges, "edges", F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "weight"))
    files = snapshot.files.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "content")))).alias("files"))
    meta = snapshot.snapshots.select("repo", "commit", F.col("built_at").alias("builtAt"), F.col("total_tokens").alias("totalTokens"), F.col("tokens_counted").alias("tokensCounted"), F.col("token_source").alias("tokenSource"))
    rows = meta.join(symbols, "repo", "left").join(edges, "repo", "left").join(files, "repo", "left")
    rows.repartition("repo").write.mode("overwrite").json(path)


def built_now(when: datetime | None = None) -> str:
    """A time of building as it is stored: in UTC, now if it isn't given."""
    return (when or datetime.now(UTC)).astimezone(UTC).isoformat()


def counted(snapshot: Snapshot, repos: DataFrame, symbols: DataFrame, built_at: str | None = None) -> Snapshot:
    """snapshot with the costs that operators.costs.count_tokens gave for it (its repos and symbols), and built_at if it is given."""
    old = snapshot.snapshots.drop("total_tokens", "tokens_counted", "token_source")
    meta = old.join(repos, "repo", "left").withColumn("tokens_counted", F.coalesce("tokens_counted", F.lit(False))).withColumn("total_tokens", F.coalesce("total_tokens", F.lit(0).cast("long")))
    meta = meta if built_at is None else meta.withColumn("built_at", F.lit(built_at))
    return Snapshot(meta, symbols, snapshot.edges, snapshot.files)


def _missing(e: Exception) -> bool:
    return getattr(e, "getCondition", lambda: "")() == "PATH_NOT_FOUND"


def pointers(spark: SparkSession, path: str) -> DataFrame | None:
    """repo and version: which version of each repo holds, the last that was pointed at. None if nothing is stored."""
    try:
        log = spark.read.schema("repo string, version string, seq bigint").parquet(f"{path}/pointers")
    except Exception as e:  # noqa: BLE001
        if _missing(e):
            return None
        raise
    return log.groupBy("repo").agg(F.max_by("version", F.struct("seq", "version")).alias("version"))


def store(snapshot: Snapshot, path: str, downgrade: bool = False) -> str:
    """Write the tables below path as a new version, and point its repos at it when all are whole; returns the version. Repos that aren't among snapshots stay at theirs.

    Nothing that is stored is touched, so a failure leaves all as it was, readers of an earlier version read on, and what load gave can be stored. Versions that nothing points at are for vacuum. Costs
    that were counted aren't replaced by estimates, unless downgrade says so: that is an error, before anything is written.
    """
    spark = snapshot.snapshots.sparkSession
    stored = load(spark, path)
    if stored is not None and not downgrade:
        counted = stored.snapshots.where("token_source = 'count_tokens'").select("repo")
        worse = snapshot.snapshots.where("token_source IS DISTINCT FROM 'count_tokens'").join(counted, "repo", "left_semi").select("repo").orderBy("repo").limit(10).collect()
        if worse:
            raise ValueError(f"counted costs would be replaced by estimates: {', '.join(r['repo'] for r in worse)}")
    version = uuid.uuid4().hex
    for name, schema in TABLES.items():
        columns = [x.split()[0] for x in schema.split(", ")]
        getattr(snapshot, name).select(*columns).write.partitionBy("repo").parquet(f"{path}/{name}/version={version}")
    seq = 1 if stored is None else spark.read.schema("seq bigint").parquet(f"{path}/pointers").agg(F.max("seq") + 1).first()[0]
    whole = load_version(spark, path, version).snapshots.select("repo").distinct()
    # one file, that a job's commit makes visible
    whole.select("repo", F.lit(version).alias("version"), F.lit(seq).cast("bigint").alias("seq")).coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return version


def load_version(spark: SparkSession, path: str, version: str) -> Snapshot:
    """The tables of one version."""
    return Snapshot(**{name: _table(spark, path, name).where(F.col("version") == version).drop("version") for name in TABLES})


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of all versions; empty where no version has a row of it."""
    try:
        return spark.read.schema(f"{TABLES[name]}, version string").parquet(f"{path}/{name}")
    except Exception as e:  # noqa: BLE001
        if _missing(e):
            return spark.createDataFrame([], f"{TABLES[name]}, version string")
        raise


def load(spark: SparkSession, path: str, repo: str | None = None) -> Snapshot | None:
    """The tables as they are pointed at, of one repo if it is given: other repos' and versions' files aren't read. None if nothing is stored."""
    now = pointers(spark, path)
    if now is None:
        return None
    if repo is not None:
        version = now.where(F.col("repo") == repo).first()
        found = load_version(spark, path, version["version"] if version else "")
        return Snapshot(*(getattr(found, name).where(F.col("repo") == repo) for name in TABLES))
    held = now.select("repo", "version").collect()  # a row for each repo
    holds = spark.createDataFrame([tuple(r) for r in held], "repo string, version string")
    return Snapshot(**{name: _table(spark, path, name).join(F.broadcast(holds), ["repo", "version"], "left_semi").drop("version") for name in TABLES})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the versions that no repo points at, and return them. No store may be under way, and no reader of an earlier version."""
    now = pointers(spark, path)
    held = {r["version"] for r in now.select("version").distinct().collect()} if now is not None else set()
    jvm = spark._jvm
    gone = set()
    for name in TABLES:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            version = status.getPath().getName().removeprefix("version=")
            if status.isDirectory() and version not in held:
                fs.delete(status.getPath(), True)
                gone.add(version)
    return sorted(gone)
