"""Validity intervals: half-open, a null end means still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def during(rows: DataFrame, intervals: DataFrame, key: str = "symbol", day: str = "session", how: str = "inner") -> DataFrame:
    """Rows inside one of their key's intervals (equi join on the key, range as residual condition)."""
    i = intervals.select(F.col(key).alias("_k"), *[F.col(c) for c in intervals.columns if c != key])
    inside = (rows[key] == i["_k"]) & (rows[day] >= i["start"]) & (i["end"].isNull() | (rows[day] < i["end"]))
    out = rows.join(i, inside, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_k")


def interval_faults(intervals: DataFrame, key: str = "symbol") -> DataFrame:
    """Inverted, overlapping, or following an open interval."""
    w = W.partitionBy(key).orderBy("start")
    x = intervals.select(key, "start", "end", F.row_number().over(w).alias("n"), F.lag("end").over(w).alias("prior_end"))
    fault = (
        F.when(F.col("end") <= F.col("start"), "INVERTED")
        .when((F.col("n") > 1) & F.col("prior_end").isNull(), "AFTER_OPEN")
        .when(F.col("start") < F.col("prior_end"), "OVERLAP")
    )
    return x.withColumn("fault", fault).where("fault is not null")


def change_log(intervals: DataFrame, key: str = "symbol") -> DataFrame:
    """Intervals to add/remove events."""
    adds = intervals.select(key, F.col("start").alias("effective"), F.lit("ADD").alias("action"))
    drops = intervals.where("end is not null").select(key, F.col("end").alias("effective"), F.lit("REMOVE").alias("action"))
    return adds.unionByName(drops)


def replay(changes: DataFrame, current: DataFrame, start: str, end: str, key: str = "symbol") -> DataFrame:
    """Intervals over [start, end] from a change log and today's members.

    Each key's log is read in order; an add opens until the next remove. A key whose first event is a
    remove was a member from before, and a current member without any event was one throughout.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    seen = changes.select(key, "effective", "action", F.lit(1).alias("o"))
    first = changes.groupBy(key).agg(F.min_by("action", "effective").alias("a")).where("a = 'REMOVE'").select(key)
    silent = current.select(key).distinct().join(changes.select(key).distinct(), key, "left_anti")
    opened = first.unionByName(silent).select(key, lo.alias("effective"), F.lit("ADD").alias("action"), F.lit(0).alias("o"))
    w = W.partitionBy(key).orderBy("effective", "o")
    x = seen.unionByName(opened).select(
        key, "effective", "action", F.lead("effective").over(w).alias("next"), F.lead("action").over(w).alias("next_action"))
    x = x.where("action = 'ADD'").select(
        key, F.greatest("effective", lo).alias("start"), F.when(F.col("next_action") == "REMOVE", F.least("next", hi)).alias("end"))
    return x.where((F.col("start") <= hi) & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
