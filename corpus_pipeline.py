"""A training corpus from raw documents: filtered, deduplicated, decontaminated, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null ids, null texts, repeated
rows and empty tables are taken by every stage, as its docstring says; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contextquarry.llm.common import materialize
from contextquarry.llm.decontaminate import clean_documents
from contextquarry.llm.jaccard_join import distinct_documents
from contextquarry.llm.mixing import mixed_documents
from contextquarry.llm.quality import good_documents, trusted_ids
from contextquarry.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of acceptable perplexity under the model of trusted text. Those without words have the mean of their language and stay; repeated rows stay or go together."""
    return good_documents(docs, trusted_ids(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the least id, a null id being greater than any other. Texts without words are copies of each other, and so are repeated rows."""
    return distinct_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items. Rows go by id and text, so others without id, or of the same id, stay. Null, empty and blank texts hold no item and stay."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them. Those without words, null texts too, are never taken; a null source is one source."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; rows of equal text share a shard. Null texts are one group, empty ones another, of size 1 each; null ids and sources don't matter."""
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The first stage trains a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
