"""Trading-calendar tables. One row per session or civil day: bounded by the calendar, never by the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flags(cal: DataFrame, window: int = 5) -> DataFrame:
    """Weekday, month, position in month and quarter, month- and quarter-end windows, turn of month."""
    month = W.partitionBy(F.trunc("session", "MM"))
    quarter = W.partitionBy(F.trunc("session", "QUARTER"))
    x = cal.select(
        "session", "pos",
        F.weekday("session").alias("weekday"),
        F.month("session").alias("month"),
        (F.row_number().over(month.orderBy("session")) - 1).alias("session_of_month"),
        (F.row_number().over(month.orderBy(F.col("session").desc())) - 1).alias("to_month_end"),
        (F.row_number().over(quarter.orderBy(F.col("session").desc())) - 1).alias("to_quarter_end"),
    )
    return x.select(
        "*",
        (F.col("to_month_end") < window).alias("month_end_window"),
        (F.col("to_quarter_end") < window).alias("quarter_end_window"),
        ((F.col("session_of_month") < 3) | (F.col("to_month_end") < 1)).alias("turn_of_month"),
    )


def civil(cal: DataFrame, pad: int = 70) -> DataFrame:
    """Each civil day with the session on it and the nearest sessions before and after (strict and not)."""
    span = cal.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    days = span.select(F.explode(F.sequence(F.date_sub("lo", pad), F.date_add("hi", pad))).alias("day"))
    x = days.join(cal.select("session", "pos"), F.col("day") == F.col("session"), "left")
    one = W.partitionBy(F.lit(1)).orderBy("day")
    up, down = (W.unboundedPreceding, 0), (0, W.unboundedFollowing)
    return x.select(
        "day", "session", "pos",
        F.last("session", True).over(one.rowsBetween(*up)).alias("on_or_before"),
        F.last("session", True).over(one.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.first("session", True).over(one.rowsBetween(*down)).alias("on_or_after"),
        F.first("session", True).over(one.rowsBetween(1, W.unboundedFollowing)).alias("after"),
    )


def observed_turn_of_month(cal: DataFrame, following: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Last session of a month (seen from the next session) and the next ``following`` sessions, of each venue in `by`."""
    one = W.partitionBy(*(by or [F.lit(1)])).orderBy("session")
    last = F.coalesce(F.trunc(F.lead("session").over(one), "MM") != F.trunc("session", "MM"), F.lit(False))
    x = cal.withColumn("boundary", last)
    return x.withColumn("tom", F.max("boundary").over(one.rowsBetween(-following, 0)))


def gap_before_next(cal: DataFrame) -> DataFrame:
    """True where at least one weekday lies between a session and the next one."""
    one = W.partitionBy(F.lit(1)).orderBy("session")
    step = F.when(F.weekday("session") == 4, 3).when(F.weekday("session") == 5, 2).otherwise(1)
    return cal.withColumn(
        "pre_holiday", F.coalesce(F.lead("session").over(one) > F.date_add("session", step), F.lit(False))
    )


def near_days(cal: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """Sessions flagged before, on and after given days (days need not be sessions)."""
    near = days.select(F.col(day).alias("day")).distinct().join(civil(cal), "day")
    before = near.where("before is not null").select(F.col("before").alias("session"), F.lit(True).alias("day_before"))
    after = near.where("after is not null").select(F.col("after").alias("session"), F.lit(True).alias("day_after"))
    on = near.where("session is not null").select("session", F.lit(True).alias("day_of"))
    x = cal
    for side in (before, on, after):
        x = x.join(side.distinct(), "session", "left")
    no = F.lit(False)
    return x.select(
        *cal.columns, F.coalesce("day_before", no).alias("day_before"), F.coalesce("day_of", no).alias("day_of"),
        F.coalesce("day_after", no).alias("day_after"),
    )


def iso_week(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.extract(F.lit("YEAROFWEEK"), c) * 100 + F.weekofyear(c)


def in_weeks_of(cal: DataFrame, days: DataFrame, day: str, out: str) -> DataFrame:
    weeks = days.select(iso_week(day).alias("_wk")).distinct().withColumn("_in", F.lit(True))
    return cal.withColumn("_wk", iso_week("session")).join(weeks, "_wk", "left").withColumn(
        out, F.coalesce("_in", F.lit(False))
    ).drop("_wk", "_in")


def third_fridays(cal: DataFrame) -> DataFrame:
    months = cal.select(F.trunc("session", "MM").alias("m")).distinct()
    return months.select("m", F.date_add(F.next_day(F.date_sub("m", 1), "FRI"), 14).alias("nominal"))


def scheduled_opex_week(cal: DataFrame) -> DataFrame:
    """ISO week of the scheduled third Friday, whether or not that Friday trades."""
    return in_weeks_of(cal, third_fridays(cal), "nominal", "opex_week")


def shifted_opex(cal: DataFrame) -> DataFrame:
    """Expiry moved to the previous session when the third Friday is closed; Saturday-to-Friday weeks."""
    expiry = third_fridays(cal).join(civil(cal), F.col("nominal") == F.col("day")).select(
        F.col("on_or_before").alias("expiry")
    ).where("expiry is not null")
    week_end = lambda c: F.next_day(F.date_sub(c, 1), "FRI")
    weeks = expiry.select(week_end("expiry").alias("_we")).distinct().withColumn("_in", F.lit(True))
    days = expiry.select(F.col("expiry").alias("session")).distinct().withColumn("_on", F.lit(True))
    x = cal.withColumn("_we", week_end("session")).join(weeks, "_we", "left").join(days, "session", "left")
    return x.select(
        *cal.columns, F.coalesce("_in", F.lit(False)).alias("opex_week"), F.coalesce("_on", F.lit(False)).alias("opex_day")
    )


FIXED_CLOSURES = ("01-01", "07-04", "12-25")  # fixed values: month-day of the yearly closures


def closures(cal: DataFrame) -> DataFrame:
    years = cal.select(F.year("session").alias("y")).distinct()
    days = F.explode(F.array(*[F.lit(d) for d in FIXED_CLOSURES]))
    return years.select("y", days.alias("md")).select(F.to_date(F.concat_ws("-", F.col("y").cast("string"), "md")).alias("holiday"))


def calendar_features(cal: DataFrame, holidays: DataFrame, events: DataFrame) -> DataFrame:
    """Every calendar flag in one table keyed by session."""
    x = flags(cal)
    h = near_days(cal, holidays, "holiday").select(
        "session", F.col("day_before").alias("pre_holiday"), F.col("day_after").alias("post_holiday"))
    e = near_days(cal, events, "event_day").select(
        "session", F.col("day_before").alias("event_day_before"), F.col("day_of").alias("event_day_of"))
    week = in_weeks_of(cal, events, "event_day", "event_week").select("session", "event_week")
    opex = scheduled_opex_week(cal).select("session", "opex_week")
    for other in (h, e, week, opex):
        x = x.join(other, "session")
    return x
