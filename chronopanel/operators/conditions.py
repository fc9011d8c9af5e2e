"""Statistics per instrument and calendar condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .inference import hac


def calendar_conditions(flags: DataFrame) -> DataFrame:
    rows = F.array_compact(F.array(
        F.concat(F.lit("WEEKDAY_"), F.col("weekday").cast("string")), F.when(F.col("turn_of_month"), "TOM"), F.when(F.col("opex_week"), "OPEX"), F.lit("ALL")))
    return flags.select("session", "pos", F.explode(rows).alias("condition"))


def shrunk_mean(mean, t):
    """Positive-part shrinkage: nothing survives |t| <= 1."""
    return F.when(F.abs(t) > 1, mean * (F.lit(1.0) - F.lit(1.0) / (t * t))).otherwise(0.0)


def condition_statistics(r: DataFrame, conditions: DataFrame, minimum: int = 60, family_alpha: float = 0.05) -> DataFrame:
    """n, hit rate, mean, HAC t, halves, worst return, shrunk mean and tier per (symbol, condition)."""
    x = r.where("ret is not null").join(conditions.select("pos", "condition"), "pos")
    group = W.partitionBy("symbol", "condition")
    h = x.withColumn("i", F.row_number().over(group.orderBy("pos"))).withColumn("m", F.count("*").over(group))
    early = F.col("i") * 2 <= F.col("m")
    s = h.groupBy("symbol", "condition").agg(
        F.avg((F.col("ret") > 0).cast("double")).alias("hit"), F.avg(F.when(early, F.col("ret"))).alias("first_half"),
        F.avg(F.when(~early, F.col("ret"))).alias("second_half"), F.min("ret").alias("worst"))
    t = hac(x, ["symbol", "condition"], "pos", "ret").where(F.col("n") >= minimum).join(s, ["symbol", "condition"])
    t = t.withColumn("shrunk", shrunk_mean(F.col("mean"), F.col("t")))
    same = F.signum("first_half") == F.signum("second_half")
    return t.withColumn("tier", F.when((F.abs("t") > 2) & same & (F.col("mean") > 0), "TAILWIND").when((F.abs("t") > 2) & same, "HEADWIND").otherwise("NEUTRAL"))


def alignment(r: DataFrame, upcoming: DataFrame) -> DataFrame:
    """Score of upcoming weekdays: sum of the means of the calendar conditions that will hold."""
    tags = lambda: F.array(F.concat(F.lit("W"), F.weekday("session").cast("string")), F.concat(F.lit("M"), F.month("session").cast("string")))
    past = r.where("ret is not null").select("ret", F.explode(tags()).alias("cond")).groupBy("cond").agg(
        F.round(F.avg("ret"), 9).alias("m"), F.round(F.avg((F.col("ret") > 0).cast("double")), 9).alias("h"))
    x = upcoming.where("weekday < 5").select("session", F.explode(tags()).alias("cond")).join(past, "cond")
    return x.groupBy("session").agg((F.sum("m") * 10000).alias("score"), F.avg("h").alias("win"))
