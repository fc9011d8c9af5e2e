"""Two records of the same market compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, columns=("close",)) -> DataFrame:
    """One-to-one join on (symbol, session) with suffixes; returns are taken before joining, on each own record."""
    def side(df, tag):
        w = W.partitionBy("symbol").orderBy("session")
        extra = [c for c in ("close", "adjusted_close", "dividend", "split_factor") if c in df.columns]
        return df.select("symbol", "session", *[F.col(c).alias(f"{c}_{tag}") for c in extra],
                         *[(F.col(c) / F.lag(c).over(w) - 1).alias(f"{c}_ret_{tag}") for c in columns],
                         F.lag("session").over(w).alias(f"prior_{tag}"), F.lag("close").over(w).alias(f"close1_{tag}"))
    return side(a, "a").join(side(b, "b"), ["symbol", "session"])


def rebased(pair: DataFrame, tolerance: float = 0.005, required: float = 0.99) -> DataFrame:
    """Both series rebased to their first common session; share of sessions within tolerance."""
    w = W.partitionBy("symbol").orderBy("session")
    x = pair.select("symbol", (F.col("close_a") / F.first("close_a").over(w)).alias("x"), (F.col("close_b") / F.first("close_b").over(w)).alias("y"))
    rel = F.abs(F.col("x") / F.col("y") - 1)
    return x.groupBy("symbol").agg(
        F.count("*").alias("n_common"), F.avg((rel <= tolerance).cast("double")).alias("within"), F.max(rel).alias("worst")).withColumn(
        "passed", F.col("within") >= required)


def action_stratified(pair: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Return agreement apart for sessions with and without a corporate action; same prior session only."""
    x = pair.where("prior_a is not null and prior_a = prior_b")
    action = (F.col("dividend_b") != 0) | (F.col("split_factor_b") != 1)
    ledger = (F.col("close_a") * F.col("split_factor_b") + F.col("dividend_b")) / F.col("close1_a") - 1
    total = (F.col("close_b") * F.col("split_factor_b") + F.col("dividend_b")) / F.col("close1_b") - 1
    plain = F.abs(F.col("close_ret_a") - F.col("close_ret_b")) <= tolerance
    full = F.abs(ledger - total) <= tolerance
    return x.groupBy("symbol").agg(
        F.count_if(~action).alias("n_plain"), F.count_if(action).alias("n_action"),
        F.avg(F.when(~action, plain.cast("double"))).alias("plain_within"), F.avg(F.when(action, full.cast("double"))).alias("action_within"))


def action_votes(pair: DataFrame, tolerance: float = 0.005, required: float = 0.95) -> DataFrame:
    """Which price convention each action of record b implies for record a, and the verdict per symbol.

    Every action session votes for RAW, SPLIT_ADJUSTED and TOTAL_RETURN where that prediction fits.
    """
    x = pair.where("prior_a is not null and prior_a = prior_b and (dividend_b <> 0 or split_factor_b <> 1)")
    observed = F.col("close_a") / F.col("close1_a")
    raw = F.col("close_b") / F.col("close1_b")
    split = raw * F.col("split_factor_b")
    total = (F.col("close_b") * F.col("split_factor_b") + F.col("dividend_b")) / F.col("close1_b")
    near = lambda p: (F.abs(observed / p - 1) <= tolerance).cast("int")
    v = x.select("symbol", near(raw).alias("raw"), near(split).alias("split"), near(total).alias("total"))
    s = v.groupBy("symbol").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("raw", "split", "total")])
    best = F.greatest("raw", "split", "total")
    name = F.when(F.col("raw") == best, "RAW").when(F.col("split") == best, "SPLIT_ADJUSTED").otherwise("TOTAL_RETURN")
    verdict = F.when(F.col("n") < 3, "UNCHECKABLE").when(best >= F.ceil(F.col("n") * F.lit(required)), "CONFIRMED").when(best == 0, "DISAGREES").otherwise("MIXED")
    return s.select("*", name.alias("convention"), verdict.alias("verdict"))
