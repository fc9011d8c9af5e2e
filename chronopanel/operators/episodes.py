"""Turn-of-month episodes with exact entry, exposure and exit sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.costs import BASE, impact_bps


def plan(cal: DataFrame) -> DataFrame:
    """(month, entry, exposure, exit) per month whose next month has at least three sessions."""
    month = F.trunc("session", "MM")
    m = cal.groupBy(month.alias("month")).agg(F.max("pos").alias("last_pos"), F.count("*").alias("n"))
    one = W.partitionBy(F.lit(1)).orderBy("month")
    m = m.withColumn("n_next", F.lead("n").over(one)).where("n_next >= 3 and last_pos > 1")
    days = lambda off, name: cal.select((F.col("pos") - off).alias("last_pos"), F.col("session").alias(name))
    for off, name in ((-1, "entry"), (0, "exposure"), (1, "next1"), (2, "next2"), (3, "exit")):
        m = m.join(days(off, name), "last_pos")
    return m


def episodes(bars: DataFrame, plan_rows: DataFrame, allocation: float = 10_000.0, adv_floor: float = 1_000_000.0) -> DataFrame:
    """Episode returns at baseline and fourfold costs; an episode needs a bar on all five sessions."""
    need = plan_rows.select("month", "entry", "exit", F.explode(F.array("entry", "exposure", "next1", "next2", "exit")).alias("session"))
    x = need.join(bars.select("symbol", "session", "close", "adjusted_close", "volume"), "session")
    at = lambda c, day: F.max(F.when(F.col("session") == F.col(day), F.col(c)))
    dollars = F.col("close") * F.col("volume")
    x = x.withColumn("dollars", F.greatest(dollars, F.lit(adv_floor)))
    e = x.groupBy("symbol", "month", "entry", "exit").agg(
        F.count("*").alias("n"), at("adjusted_close", "entry").alias("p0"), at("adjusted_close", "exit").alias("p1"), at("dollars", "entry").alias("a0"), at("dollars", "exit").alias("a1")).where("n = 5")
    side = lambda adv: F.lit(BASE.etf_spread / 2 + BASE.turnover_penalty) + impact_bps(F.lit(allocation), F.col(adv))
    g, c0, c1 = F.col("p1") / F.col("p0"), side("a0") / 10_000.0, side("a1") / 10_000.0
    net = lambda k: g * (F.lit(1.0) - c0 * k) * (F.lit(1.0) - c1 * k) - 1
    return e.select("symbol", "month", "entry", "exit", (g - 1).alias("gross"), ((c0 + c1) * 10_000.0).alias("cost_bps"), net(1.0).alias("net"), net(4.0).alias("net_4x"))


def evaluate(e: DataFrame, minimum: int = 12) -> DataFrame:
    """Means, hit rate, positive years and gates per symbol (an episode table has one row per month)."""
    years = e.groupBy("symbol", F.year("exit").alias("y")).agg((F.product(F.col("net") + 1) - 1).alias("a")).groupBy("symbol").agg(
        F.avg((F.col("a") > 0).cast("double")).alias("positive_years"))
    s = e.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.avg("net_4x").alias("mean_4x"), F.avg((F.col("net") > 0).cast("double")).alias("hit"))
    x = s.join(years, "symbol")
    return x.withColumn("gate_sample", F.col("n") >= minimum).withColumn("gate_costs", F.col("mean_4x") > 0).withColumn("gate_years", F.col("positive_years") >= 0.6)


def upcoming(plan_rows: DataFrame, after) -> DataFrame:
    """Next entry strictly after a date."""
    return plan_rows.where(F.col("entry") > F.lit(after).cast("date")).agg(F.min(F.struct("entry", "exposure", "exit")).alias("t")).select("t.*")
