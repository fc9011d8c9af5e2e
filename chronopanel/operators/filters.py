"""Row rules: availability, vetoes, retention, verdicts. Every failing rule leaves its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def as_of(df: DataFrame, moment: Column | str, available: str = "available_at") -> DataFrame:
    t = F.lit(moment).cast("timestamp") if isinstance(moment, str) else moment
    return df.where(F.col(available) <= t)


def assert_as_of(df: DataFrame, moment: str, available: str = "available_at") -> DataFrame:
    """The same rows, failing the job when one of them was not available yet."""
    late = F.col(available) > F.lit(moment).cast("timestamp")
    return df.where(F.when(late, F.raise_error(F.lit("row not yet available"))).otherwise(F.lit(True)).cast("boolean"))


def reasons(**rules: Column) -> Column:
    """Array of the names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def vetoed(decisions: DataFrame, events: DataFrame, before_days: int = 7) -> DataFrame:
    """Decisions stopped by an event known at the decision: earnings from ``before_days`` earlier until the
    holding ends, negative guidance in the same span, or a halt that has not ended."""
    # Only the day of an event matters here, so copies collapse to at most one row per day and kind.
    e = events.where(F.col("kind").isin("EARNINGS", "GUIDANCE_NEGATIVE", "HALT")).select(
        F.col("symbol").alias("_s"), "kind", "event_day", "available_day", "ended_day").distinct()
    span = (F.col("event_day") >= F.date_sub("session", before_days)) & (F.col("event_day") <= F.col("hold_end"))
    past = (F.col("event_day") >= F.date_sub("session", before_days)) & (F.col("event_day") <= F.col("session"))
    halt = (F.col("event_day") <= F.col("session")) & (F.coalesce("ended_day", F.lit("9999-12-31").cast("date")) > F.col("session"))
    hit = (
        (F.col("symbol") == F.col("_s"))
        & (F.col("available_day") <= F.col("session"))
        & (((F.col("kind") == "EARNINGS") & span) | ((F.col("kind") == "GUIDANCE_NEGATIVE") & past) | ((F.col("kind") == "HALT") & halt))
    )
    return decisions.join(e, hit, "left_semi")


def time_class(minutes: Column) -> Column:
    """Auction anchor of a New York clock time."""
    return (
        F.when(minutes < 570, "PRE_OPEN").when(minutes < 600, "OPEN").when(minutes < 930, "MIDDAY")
        .when(minutes < 960, "CLOSE").otherwise("AFTER_HOURS")
    )


def retained_intraday(rows: DataFrame, finalists: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """Minute rows inside the regular session; ticks only for finalists around the close."""
    m = clock.clock_minutes(at)
    minute = rows.where((F.col(kind) == "MINUTE") & m.between(570, 960))
    ticks = rows.where((F.col(kind) != "MINUTE") & m.between(915, 965)).join(finalists.select(key).distinct(), key, "left_semi")
    return minute.unionByName(ticks.select(*minute.columns))


def timer_columns(x: DataFrame) -> DataFrame:
    """Entry timer by edge type, and its trigger from the indicator columns."""
    long = F.col("direction") == "LONG"
    pull = F.when(long, (F.col("rsi2") < 10) | (F.col("pct_b") < 0.2)).otherwise((F.col("rsi2") > 90) | (F.col("pct_b") > 0.8))
    out = F.when(long, F.col("px") >= F.col("high20")).otherwise(F.col("px") <= F.col("low20"))
    timer = F.when(F.col("edge") == "REVERSAL", "PULLBACK").when(F.col("edge") == "MOMENTUM", "BREAKOUT").otherwise("IMMEDIATE")
    counter = (long & (F.col("regime") == "DOWN")) | (~long & (F.col("regime") == "UP"))
    timer = F.when(counter & (F.col("edge") == "MOMENTUM"), "BLOCKED").otherwise(timer)
    fired = F.when(timer == "PULLBACK", pull).when(timer == "BREAKOUT", out).when(timer == "IMMEDIATE", True).otherwise(False)
    return x.select("*", timer.alias("timer"), F.coalesce(fired, F.lit(False)).alias("fired"))


def capability_gates(members: DataFrame, tickers: DataFrame, kinds: DataFrame, required: list[str], key: str = "symbol") -> DataFrame:
    """One status row per data capability."""
    n_members = members.select(key).distinct()
    unmapped = n_members.join(tickers.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("bad"))
    total = n_members.agg(F.count("*").alias("n"))
    membership = total.join(unmapped).select(
        F.lit("MEMBERSHIP").alias("capability"),
        F.when(F.col("n") == 0, "DATA_UNAVAILABLE").when(F.col("bad") > 0, "FAIL").otherwise("PASS").alias("status"),
        F.col("bad").alias("missing"))
    have = kinds.groupBy(key).agg(F.collect_set("kind").alias("have"))  # the set is at most the closed kind list
    need = F.array(*[F.lit(k) for k in required])
    short = n_members.join(have, key, "left").select(
        F.size(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))).alias("short"))
    coverage = short.agg(F.count_if(F.col("short") > 0).alias("missing"), F.count("*").alias("n")).select(
        F.lit("AUCTION_COVERAGE").alias("capability"),
        F.when(F.col("n") == 0, "DATA_UNAVAILABLE").when(F.col("missing") > 0, "FAIL").otherwise("PASS").alias("status"), "missing")
    return membership.unionByName(coverage)
