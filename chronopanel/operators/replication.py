"""Known effects as pass or fail rows: what must hold on a panel before anything new is believed.

Each check returns (check, passed, statistic, first, second, n). A statistic that cannot be computed is null and the
check has not passed. The market series has a row per session, so it is bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import compounded
from .inference import event_difference, hac


def _row(df: DataFrame, check: str, passed: Column, statistic: Column, first: Column, second: Column, n: Column) -> DataFrame:
    # At most one row comes in; exactly one goes out, so a check without any data has not passed.
    x = df.select(passed.alias("p"), statistic.cast("double").alias("statistic"), first.cast("double").alias("first"), second.cast("double").alias("second"), n.cast("bigint").alias("n"))
    x = x.agg(F.max("p").alias("p"), *[F.max(c).alias(c) for c in ("statistic", "first", "second")], F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return x.select(F.lit(check).alias("check"), F.coalesce("p", F.lit(False)).alias("passed"), "statistic", "first", "second", "n")


def turn_of_month(market: DataFrame, flags: DataFrame) -> DataFrame:
    """Mean on turn-of-month sessions minus the rest is positive with t over 2; first and second are the two means."""
    x = market.join(flags.select("pos", "turn_of_month"), "pos").withColumn("g", F.lit(1))
    d = event_difference(x, ["g"], "pos", "mkt", "turn_of_month")
    c = F.col
    return _row(d, "turn_of_month", (c("difference") > 0) & (c("t") > 2), c("t"), c("event_mean"), c("rest_mean"), c("n_event"))


def event_day(market: DataFrame, days: DataFrame, start: str, end: str) -> DataFrame:
    """Mean of event sessions inside [start, end] is positive with plain t over 2; second is the mean after ``end``."""
    on = market.join(days.select(F.col("event_day").alias("session")).distinct(), "session", "left_semi").withColumn("g", F.lit(1))
    past, later = on.where(F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), on.where(F.col("session") > F.lit(end).cast("date"))
    t = hac(past, ["g"], "pos", "mkt", requested=0).crossJoin(later.agg(F.avg("mkt").alias("later")))  # one row each
    c = F.col
    return _row(t, "pre_event", (c("mean") > 0) & (c("t") > 2), c("t"), c("mean"), c("later"), c("n"))


def overnight_dominance(r: DataFrame, share: float = 0.75) -> DataFrame:
    """On every instrument the overnight log return exceeds the intraday one and is ``share`` of a positive total.

    The statistic is the least margin, first the least share; n counts instruments.
    """
    x = r.where("px1 is not null").groupBy("symbol").agg(F.sum(F.ln(F.col("open_adj") / F.col("px1"))).alias("o"), F.sum(F.ln(F.col("px") / F.col("open_adj"))).alias("i"))
    part = F.when(F.col("o") + F.col("i") > 0, F.col("o") / (F.col("o") + F.col("i")))
    x = x.withColumn("share", part).withColumn("good", F.coalesce((F.col("o") > F.col("i")) & (F.col("share") >= share), F.lit(False)))
    s = x.agg(F.every("good").alias("good"), F.min(F.col("o") - F.col("i")).alias("margin"), F.min("share").alias("least"), F.count("*").alias("n"))
    return _row(s, "overnight_dominance", F.col("good"), F.col("margin"), F.col("least"), F.lit(None), F.col("n"))


def momentum_crash(spread: DataFrame, start: str, end: str, width: int = 63, loss: float = -0.20) -> DataFrame:
    """Positive mean of the spread, and a ``width``-session return of ``loss`` or less that ends inside [start, end]."""
    x = spread.withColumn("g", F.lit(1))
    x = x.withColumn("_c", compounded("gross", width, key="g"))
    inside = F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    s = x.agg(F.avg("gross").alias("mean"), F.min(F.when(inside, F.col("_c"))).alias("worst"), F.count("gross").alias("n"))
    return _row(s, "momentum", (F.col("mean") > 0) & (F.col("worst") <= loss), F.col("mean"), F.col("worst"), F.lit(None), F.col("n"))


def reversal_cost_damage(stream: DataFrame) -> DataFrame:
    """Positive gross mean of which costs take at least half; first is the gross mean, second net over gross."""
    s = stream.agg(F.avg("gross").alias("g"), F.avg("net").alias("m"), F.count("net").alias("n"))
    g, m = F.col("g"), F.col("m")
    return _row(s, "short_term_reversal", (g > 0) & ((m <= 0) | (m <= 0.5 * g)), m, g, m / F.nullif(g, F.lit(0.0)), F.col("n"))


def monday_decay(market: DataFrame, early_before: str, late_from: str, most: float = 0.0005) -> DataFrame:
    """Monday minus the rest: t under -2 early; late neither significant nor ``most`` in size. First and second are
    the early and late difference, n the late Mondays."""
    day = F.col("session")
    period = F.when(day < F.lit(early_before).cast("date"), "early").when(day >= F.lit(late_from).cast("date"), "late")
    x = market.withColumn("g", period).where("g is not null").withColumn("monday", F.weekday("session") == 0)
    d = event_difference(x, ["g"], "pos", "mkt", "monday")
    pick = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    s = d.agg(*[pick(g, c).alias(f"{g}_{c}") for g in ("early", "late") for c in ("difference", "t")], pick("late", "n_event").alias("n"))
    c = F.col
    good = (c("early_difference") < 0) & (c("early_t") < -2) & (F.abs("late_t") < 1.96) & (F.abs("late_difference") < most)
    return _row(s, "monday_effect", good, c("late_t"), c("early_difference"), c("late_difference"), c("n"))


def suite(*checks: DataFrame) -> DataFrame:
    """All checks with ``promote``: new research may go on only if every one has passed."""
    x = reduce(DataFrame.unionByName, checks)
    return x.crossJoin(F.broadcast(x.agg(F.every("passed").alias("promote"))))  # one row
