"""Paper ledgers in batch form: marks, outcomes, reconciliation, lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import ieee_ratio


def accepted_marks(marks: DataFrame) -> DataFrame:
    """A mark counts only when later than every earlier-arrived one; running extremes of accepted prices."""
    w = W.partitionBy("recommendation_id").orderBy("arrival")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    x = marks.withColumn("accepted", F.coalesce(F.col("at") > F.max("at").over(past), F.lit(True)))
    p = F.when(F.col("accepted"), F.col("price"))
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    return x.select("recommendation_id", "event_id", "accepted", F.min(p).over(so_far).alias("low"), F.max(p).over(so_far).alias("high"))


def excursions(marks: DataFrame, entry: DataFrame) -> DataFrame:
    """Worst and best move since entry, by direction, after each mark; infinite moves from an entry at zero."""
    x = marks.join(entry, "recommendation_id")
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    x = x.withColumn("move", sign * (ieee_ratio(F.col("price"), F.col("fill")) - 1))
    w = W.partitionBy("recommendation_id").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return x.select("recommendation_id", "event_id", F.least(F.lit(0.0), F.min("move").over(w)).alias("mae"), F.greatest(F.lit(0.0), F.max("move").over(w)).alias("mfe"))


def outcomes(rows: DataFrame, cost: float = 0.001, last_seen: DataFrame | None = None) -> DataFrame:
    """Net outcome of closed recommendations. An exit before the last observation of its recommendation
    (``last_seen``: recommendation_id, seen_at) is refused."""
    x = rows.where("exit_price is not null")
    if last_seen is not None:
        x = x.join(last_seen, "recommendation_id", "left").where(F.col("seen_at").isNull() | (F.col("exit_at") >= F.col("seen_at")))
    return x.select("recommendation_id", "ret", (F.col("ret") - F.lit(cost)).alias("net"))


def reconcile(decisions: DataFrame, bars: DataFrame, slippage_bps: float = 15.0) -> DataFrame:
    """Fill at the entry open, exit at the slipped stop or the open when the low breaches the stop, else at
    the scheduled close. Each decision meets its own sessions by equality; only the first exit counts."""
    held = decisions.withColumn("pos", F.explode(F.sequence("entry_pos", "exit_pos")))
    x = held.join(bars.select("symbol", "pos", "open_adj", "low_adj", "px"), ["symbol", "pos"])
    key = ["decision", "symbol", "entry_pos", "exit_pos", "stop"]
    breach = F.col("low_adj") <= F.col("stop")
    s = x.groupBy(*key).agg(
        F.max(F.when(F.col("pos") == F.col("entry_pos"), F.col("open_adj"))).alias("fill"),
        F.min(F.when(breach, F.struct("pos", "open_adj"))).alias("b"), F.max(F.when(F.col("pos") == F.col("exit_pos"), F.col("px"))).alias("scheduled"))
    stopped = F.col("b").isNotNull()
    price = F.when(stopped, F.least(F.col("stop") * (1 - slippage_bps / 10_000.0), F.col("b.open_adj"))).otherwise(F.col("scheduled"))
    return s.where("fill is not null").select(
        *key, "fill", price.alias("exit_price"), F.when(stopped, "STOP").when(F.col("scheduled").isNotNull(), "SCHEDULED").otherwise("OPEN").alias("reason"))


def lanes(marks: DataFrame, limit: float = -0.30) -> DataFrame:
    """Latest and peak equity per lane; a lane that ever fell 30 % below its peak has ended."""
    from .running import running

    x = running(marks.withColumn("hour", F.date_trunc("hour", "at")), ["lane"], "hour", ["at", "event_id"], maxima={"peak": "equity"})
    dead = (F.col("equity") / F.col("peak") - 1 <= limit) | (F.col("equity") <= 0)
    return x.groupBy("lane").agg(F.max_by("equity", clock.arrival_key("at", "event_id")).alias("equity"), F.max("peak").alias("peak"), F.bool_or(dead).alias("terminated"))


def revalidation(price: Column, plan: Column, age_seconds: Column, halted: Column, regime: Column, atr: Column) -> Column:
    """Ordered checks of a pending plan against its newest quote."""
    move = F.abs(price - plan)
    return (
        F.when(price.isNull(), "NO_QUOTE").when(price <= 0, "BAD_PRICE").when(age_seconds < 0, "FUTURE_QUOTE").when(age_seconds > 1800, "STALE_QUOTE")
        .when(halted, "HALTED").when(~regime, "REGIME_OFF").when(move > atr * 2, "MOVED_TOO_FAR").when(move > atr * 0.5, "ADJUST_LIMIT").otherwise("CONFIRMED"))
