"""Per-instrument state and guidance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "symbol", order: str = "session") -> DataFrame:
    """Last row per key, combined map-side: a key's history is never sorted."""
    row = F.max_by(F.struct(*df.columns), order).alias("row")
    return df.groupBy(F.col(key).alias("_key")).agg(row).select("row.*")


def current_state(p: DataFrame) -> DataFrame:
    own = W.partitionBy("symbol").orderBy("session")
    x = p.withColumn("r", F.col("px") / F.lag("px").over(own) - 1)
    f20, f200 = own.rowsBetween(-19, 0), own.rowsBetween(-199, 0)
    x = x.select(
        "*",
        F.when(F.count("px").over(f200) == 200, F.avg("px").over(f200)).alias("ma200"),
        (F.when(F.count("r").over(f20) == 20, F.stddev_samp("r").over(f20)) * F.lit(252.0**0.5)).alias("vol20"),
        ((F.col("px") - F.col("low_adj")) / F.nullif(F.col("high_adj") - F.col("low_adj"), F.lit(0.0))).alias("ibs"),
        F.coalesce(
            (F.col("r") < 0) & (F.lag("r").over(own) < 0) & (F.lag("r", 2).over(own) < 0), F.lit(False)
        ).alias("three_down"),
    )
    x = latest(x)
    return x.select(
        "*",
        F.coalesce((F.col("vol20") < 1.4) & (F.col("ibs") > 0.2), F.lit(False)).alias("calm"),
        F.coalesce((F.col("px") < F.col("ma200")) & (F.col("ibs") < 0.2), F.lit(False)).alias("dip"),
    )


def stop_and_gap(p: DataFrame, indicators: DataFrame, multiple: float = 2.0) -> DataFrame:
    """Long stop below the last price, 99 % adverse opening gap, latest gap in ATR."""
    own = W.partitionBy("symbol").orderBy("session")
    x = p.withColumn("p1", F.lag("px").over(own))
    gaps = x.where("p1 is not null").groupBy("symbol").agg(
        F.percentile(F.greatest(F.lit(1.0) - F.col("open_adj") / F.col("p1"), F.lit(0.0)), F.lit(0.99)).alias("gap_p99")
    )
    last = latest(x).join(
        indicators.select("symbol", "session", F.col("atr14_early").alias("atr14")), ["symbol", "session"]
    )
    return last.join(gaps, "symbol").select(
        "symbol", "atr14", (F.col("px") - F.lit(multiple) * F.col("atr14")).alias("stop_long"), "gap_p99",
        ((F.col("open_adj") - F.col("p1")) / F.col("atr14")).alias("gap_atr"),
    )
