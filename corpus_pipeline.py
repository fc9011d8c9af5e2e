"""Cleaning of `documents` in five stages, each written as Parquet and read again as the next one's input.

Quality rules drop documents, SimHash keeps one document of each group, secrets are replaced in the texts, sources are
mixed to their weights (a document taken twice is there twice), and what is left is encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronopanel.llm import encoding, mixing, quality, secrets, simhash
from chronopanel.llm.common import python_ready, staged

#: The first stage draws its verdict with a trained model: SQL cannot state it.
ORACLE_SQL = None


def worth_keeping(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What passes the fixed rules and the trees; the trees learn from the labelled documents among the input."""
    python_ready(spark)
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(docs, trees).filter("verdict.kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-copies."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span, found by pattern or by ownership, becomes [SECRET]; no document goes."""
    return secrets.redacted(secrets.scan(docs, docs.columns), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row of the mix."""
    return encoding.encode(docs)


STAGES = [
    ("quality rules", worth_keeping),
    ("SimHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("BPE encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
