"""Upcoming-session alert rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def earnings_windows(events: DataFrame, gap_days: int | None = 91, slack: int = 7) -> DataFrame:
    """Expected next announcement: last one plus a gap. With ``gap_days=None`` the gap is the median of
    the symbol's own gaps of 60 to 130 days, 91 where there is none."""
    e = events.where("kind = 'EARNINGS'").select("symbol", "event_day").distinct()
    w = W.partitionBy("symbol").orderBy("event_day")
    e = e.withColumn("gap", F.datediff("event_day", F.lag("event_day").over(w)))
    own = F.percentile(F.when(F.col("gap").between(60, 130), F.col("gap")), F.lit(0.5))
    gap = F.coalesce(own, F.lit(91.0)) if gap_days is None else F.lit(float(gap_days))
    x = e.groupBy("symbol").agg(F.max("event_day").alias("last"), gap.alias("gap"))
    expected = F.date_add("last", F.floor("gap").cast("int"))
    return x.select("symbol", "gap", expected.alias("expected"), F.date_sub(expected, slack).alias("lo"), F.date_add(expected, slack).alias("hi"))


def weekday_expectation(r: DataFrame) -> DataFrame:
    return r.where("ret is not null").groupBy("symbol", F.weekday("session").alias("weekday")).agg(
        F.round(F.avg("ret") * 10000, 3).alias("expected_bp"))


def upcoming_days(cal: DataFrame, days: int) -> DataFrame:
    """The civil days after the last session (``days`` of them)."""
    last = cal.agg(F.max("session").alias("s"))
    return last.select(F.explode(F.sequence(F.date_add("s", 1), F.date_add("s", days))).alias("session")).withColumn(
        "weekday", F.weekday("session"))


def entry_table(expectation: DataFrame, upcoming: DataFrame, windows: DataFrame, threshold: float = 15.0) -> DataFrame:
    x = expectation.join(upcoming, "weekday").join(windows.select("symbol", "lo", "hi"), "symbol", "left")
    close = F.coalesce(F.col("session").between(F.col("lo"), F.col("hi")), F.lit(False))
    good = F.col("expected_bp") >= threshold
    return x.select(
        "symbol", "session", "weekday", "expected_bp",
        F.when(close, "CAUTION_EARNINGS").when(good, "GOOD").otherwise("WAIT").alias("verdict"),
        F.when(good & ~close, F.format_string("%s %s", "symbol", F.date_format("session", "yyyy-MM-dd"))).alias("line"))
