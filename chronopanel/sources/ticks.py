"""Event rows as intraday trades: symbol, timestamps on both clocks, price, size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import table


def as_ticks(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("session"),
        "user_id",
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))
