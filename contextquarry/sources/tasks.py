"""Evaluation tasks from JSON: what a ranking should find for a task, and what is wrong with rows that say no such thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a task.
REPO, TASK, EXPECT, WHY = "repo", "task", "expect", "why"


def read_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and malformed rows of the files below path: a file is a JSON array of tasks, or has a task in each line.

    Tasks: file, at (the place in the file, from 0), repo, task, expect (array of ids, each once), why. Malformed: file, at, reason, row (its text). A file is a row here, so it is one that
    people write. Reasons: 'not JSON', 'not an object', and the first field that isn't as it has to be: repo and task are strings with something in them, expect is a list of strings, not empty.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    whole = files.withColumn("v", F.try_parse_json("text"))
    listed = F.schema_of_variant("v").startswith("ARRAY")
    rows = F.when(listed, F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda x: x.cast("string")))
    lines = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    # the parser stops at the end of a value: only if no line is one by itself, the text is an object over several lines
    single = F.when(~listed & F.try_parse_json(F.get(lines, F.lit(0))).isNull(), F.array("text"))
    each = whole.select("file", F.posexplode(F.coalesce(rows, single, lines)).alias("at", "row"))
    v = F.try_parse_json("row")
    kind = lambda field: F.schema_of_variant(F.try_variant_get("v", f"$.{field}", "variant"))
    text = lambda field: F.when(kind(field) == "STRING", F.try_variant_get("v", f"$.{field}", "string"))
    expect = F.when(kind(EXPECT) == "ARRAY<STRING>", F.try_variant_get("v", f"$.{EXPECT}", "array<string>"))
    read = each.withColumn("v", v).select("file", F.col("at").cast("long").alias("at"), "row", F.col("v").alias("v"), text(REPO).alias("repo"), text(TASK).alias("task"), F.array_distinct(expect).alias("expect"), text(WHY).alias("why"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object")
        .when(blank("repo"), REPO).when(blank("task"), TASK).when(F.coalesce(F.size("expect"), F.lit(0)) < 1, EXPECT)
    )
    read = read.withColumn("reason", reason).drop("v")
    return read.where("reason IS NULL").select("file", "at", "repo", "task", "expect", "why"), read.where("reason IS NOT NULL").select("file", "at", "reason", "row")


def unknown_ids(tasks: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, at, id: what tasks expect and their repos don't have. It counts as not found."""
    return tasks.select("file", "at", "repo", F.explode("expect").alias("id")).join(symbols.select("repo", "id"), ["repo", "id"], "left_anti").select("file", "at", "id")
