"""Cross-sections: ranks, extreme portfolios and top-k inside one session or month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percent_rank_average(value: str, by=("session",), ascending: bool = True, minimum: int = 2) -> Column:
    """Average-tie rank over the count of non-null values; null for thin groups."""
    v = F.col(value)
    group = W.partitionBy(*by)
    order = group.orderBy(v.isNull(), v if ascending else v.desc())
    tied = F.count(v).over(W.partitionBy(*by, value))
    n = F.count(v).over(group)
    return F.when(v.isNotNull() & (n >= minimum), (F.rank().over(order) + (tied - 1) / 2.0) / n)


def decile_weights(df: DataFrame, value: str, quantile: float = 0.1, out: str = "weight", by=("session",)) -> DataFrame:
    """Equal long weights above the top quantile, equal short weights at or below the bottom one."""
    group = W.partitionBy(*by)
    x = df.withColumn("_p", percent_rank_average(value, by))
    long, short = F.col("_p") > 1.0 - quantile, F.col("_p") <= quantile
    x = x.withColumn("_l", F.coalesce(long, F.lit(False)).cast("double")).withColumn("_s", F.coalesce(short, F.lit(False)).cast("double"))
    w = F.coalesce(F.col("_l") / F.nullif(F.sum("_l").over(group), F.lit(0.0)), F.lit(0.0)) - F.coalesce(
        F.col("_s") / F.nullif(F.sum("_s").over(group), F.lit(0.0)), F.lit(0.0))
    return x.withColumn(out, w).drop("_p", "_l", "_s")


def side_ranks(value: str, by=("session",), tie: str = "symbol") -> tuple[Column, Column, Column]:
    """(rank from the top, rank from the bottom, eligible count); ties go to the smaller name."""
    group = W.partitionBy(*by)
    v = F.col(value)
    top = F.row_number().over(group.orderBy(v.desc_nulls_last(), tie))
    bottom = F.row_number().over(group.orderBy(v.asc_nulls_last(), tie))
    return top, bottom, F.count(v).over(group)


def top_k_entries(df: DataFrame, value: str, ks, by=("session",), tie: str = "symbol") -> DataFrame:
    """Equal-weight entries for several breadths and both sides from one ranking pass.

    Only selected rows are emitted: a row is repeated once per breadth that contains it.
    """
    top, bottom, n = side_ranks(value, by, tie)
    x = df.where(F.col(value).isNotNull()).select("*", top.alias("_top"), bottom.alias("_bot"), n.alias("_n"))
    biggest = max(ks)
    x = x.where((F.col("_top") <= biggest) | (F.col("_bot") <= biggest))
    picks = F.array_compact(F.array(*[
        F.when((F.col(rank) <= k) & (F.col("_n") >= k),
               F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(sign / k).alias("weight")))
        for k in ks for rank, side, sign in (("_top", "LONG", 1.0), ("_bot", "SHORT", -1.0))
    ]))
    return x.select(*df.columns, F.inline(picks))


def month_end_rows(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Rows on the last observed session of each month."""
    ends = cal.groupBy(F.trunc("session", "MM").alias("month")).agg(F.max("session").alias("session"))
    return df.join(ends, "session", "left_semi")


def top_fraction(df: DataFrame, value: str, denominator: int, minimum: int, ascending: bool, by=("session",)) -> DataFrame:
    """floor(n / denominator) extreme names per group, none when that is below ``minimum``."""
    v = F.col(value)
    group = W.partitionBy(*by)
    order = group.orderBy(v.asc() if ascending else v.desc(), "symbol")
    x = df.where(v.isNotNull()).withColumn("_take", F.floor(F.count(v).over(group) / F.lit(denominator))).withColumn(
        "rank", F.row_number().over(order))
    return x.where((F.col("rank") <= F.col("_take")) & (F.col("_take") >= minimum)).withColumn(
        "names", F.col("_take").cast("bigint")).drop("_take")
