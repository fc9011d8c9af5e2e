"""All calendar hypotheses in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trials import calendar_predicates, predicate_sessions, predicate_table, shapes


def calendar_trials(spark: SparkSession, flags: DataFrame, legs: DataFrame, cal: DataFrame) -> DataFrame:
    """n, mean and total return of every predicate x leg x holding x direction.

    Predicates hold on the session whose return is earned, so the decision sits one row earlier and the
    first session can hold nothing. Holding spreads a hit over following sessions, clipped to one unit.
    Hypotheses and calendar are both small; only their hits are joined to returns.
    """
    rows = calendar_predicates(flags)
    every = flags.select(F.lit("ANY").alias("hypothesis"), "session", "pos")
    hits = predicate_sessions(predicate_table(spark), rows).unionByName(every)
    x = hits.select("hypothesis", "pos", F.inline(shapes()))
    x = x.select("hypothesis", "leg", "holding", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("holding") - 1)).alias("pos"))
    x = x.where("pos >= 2").distinct().join(legs.select("pos", "leg", "r"), ["pos", "leg"])
    s = x.groupBy("hypothesis", "leg", "holding").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.sum("r").alias("t")).where("n > 0")
    sides = F.array(F.struct(F.lit("LONG").alias("d"), F.lit(1.0).alias("s")), F.struct(F.lit("SHORT").alias("d"), F.lit(-1.0).alias("s")))
    s = s.select("*", F.inline(sides))
    return s.select(F.concat_ws("|", "hypothesis", "leg", F.col("holding").cast("string"), "d").alias("trial"), "n", (F.col("m") * F.col("s")).alias("mean"), (F.col("t") * F.col("s")).alias("total"))
