"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    folder = tempfile.mkdtemp(prefix="contextquarry-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or on one machine, as in tests, a temporary one that ends with the process where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/contextquarry-{spark.sparkContext.applicationId}"


#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, free: bool = False, block: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no more than its own tasks.

    What an application has written lies in one folder of the application's id, to be removed when it has ended. free: the shuffle files of what is written are removed when it is.
    block: bytes of a block of the files, which a reader of nested columns holds whole.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true" if free else before)
    try:
        df.write.mode("overwrite").options(**({"parquet.block.size": str(block)} if block else {})).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
