"""Reading, stage tables and sizes shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: short plans, and rows that no later failure can change."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession, rows_per_batch: int = 1000) -> None:
    """The package on every worker, and Arrow batches small enough for long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column="text"):
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
