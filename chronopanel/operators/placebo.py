"""Placebo inputs from counter-based numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(seed: int, *cols):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def shuffled_dates(cal: DataFrame, seed: int) -> DataFrame:
    """(pos, from_pos): one permutation of the calendar for the whole cross-section."""
    one = W.partitionBy(F.lit(1))
    a = cal.select("pos", F.row_number().over(one.orderBy("pos")).alias("k"))
    b = cal.select(F.col("pos").alias("from_pos"), F.row_number().over(one.orderBy(order_key(seed, F.col("session")), "pos")).alias("k"))
    return a.join(b, "k").select("pos", "from_pos")


def permuted_labels(names: DataFrame, seed: int, key: str = "symbol") -> DataFrame:
    """(symbol, from_symbol): one global permutation of asset labels."""
    one = W.partitionBy(F.lit(1))
    a = names.select(key, F.row_number().over(one.orderBy(key)).alias("k"))
    b = names.select(F.col(key).alias(f"from_{key}"), F.row_number().over(one.orderBy(order_key(seed, F.col(key)), key)).alias("k"))
    return a.join(b, "k").select(key, f"from_{key}")


def rotated(cal: DataFrame, shift: int) -> DataFrame:
    """(pos, from_pos): circular rotation of the calendar."""
    n = cal.agg(F.max("pos").alias("n"))
    return cal.join(F.broadcast(n)).select("pos", (F.pmod(F.col("pos") - 1 - shift, F.col("n")) + 1).cast("int").alias("from_pos"))
