"""Outcome-risk aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def loss_profile(df: DataFrame, key: str, value: str, minimum: int = 1) -> DataFrame:
    """Loss probability, mean of the worst 5 %, 10 % quantile, worst value, mean per key.

    The quantile is an aggregate joined back, so no window holds a whole key.
    """
    x = df.where(F.col(value).isNotNull())
    cuts = x.groupBy(key).agg(F.percentile(value, F.lit(0.05)).alias("q05"), F.percentile(value, F.lit(0.1)).alias("q10"))
    v = F.col(value)
    return x.join(cuts, key).groupBy(key).agg(
        F.count(v).alias("n"),
        F.round(F.avg(F.when(v <= F.col("q05"), v)), 9).alias("es"),
        F.round(F.avg(F.when(v < 0, 1.0).otherwise(0.0)), 9).alias("p_loss"),
        F.first("q10").alias("q10"),
        F.round(F.min(v), 9).alias("worst"),
        F.round(F.avg(v), 9).alias("mean"),
    ).where(F.col("n") >= minimum)


def run_lengths(df: DataFrame, key: str, order: str, flag) -> DataFrame:
    """Lengths of consecutive true runs per key."""
    w = W.partitionBy(key).orderBy(order)
    x = df.select(key, order, flag.alias("_f")).withColumn("_i", F.row_number().over(w))
    x = x.where("_f").withColumn("_g", F.col("_i") - F.row_number().over(w))
    return x.groupBy(key, "_g").agg(F.count("*").alias("length")).groupBy(key).agg(
        F.count("*").alias("n_runs"), F.max("length").alias("longest"),
        F.percentile("length", F.lit(0.5)).alias("median_length"), F.percentile("length", F.lit(0.9)).alias("p90_length"))
