"""Announcements, ledgers and executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import ieee_ratio
from .calendar import civil


def attach_availability(quarters: DataFrame, announcements: DataFrame, days: int = 90) -> DataFrame:
    """First announcement within ``days`` after quarter end unless the filing came first."""
    a = announcements.select("symbol", "event_day").distinct()
    hit = quarters.join(a, "symbol").where((F.col("event_day") > F.col("quarter_end")) & (F.col("event_day") <= F.date_add("quarter_end", days)))
    first = hit.groupBy("symbol", "quarter_end").agg(F.min("event_day").alias("d"))
    x = quarters.join(first, ["symbol", "quarter_end"], "left")
    early = F.coalesce(F.col("d") <= F.col("filed"), F.lit(False))
    return x.select("symbol", "quarter_end", "value", F.when(early, F.col("d")).otherwise(F.col("filed")).alias("available"),
                    F.when(early, "ANNOUNCEMENT").otherwise("FILING").alias("source"))


def unexpected_earnings(eps: DataFrame, history: int = 8, minimum: int = 6) -> DataFrame:
    """Seasonal difference over the sd of the previous differences (a quarter key makes gaps visible)."""
    prior = eps.select("symbol", (F.col("q") + 4).alias("q"), F.col("value").alias("prior"))
    x = eps.join(prior, ["symbol", "q"]).withColumn("difference", F.col("value") - F.col("prior"))
    w = W.partitionBy("symbol").orderBy("q").rangeBetween(-history, -1)
    sd = F.stddev_samp("difference").over(w)
    return x.select("symbol", "q", "difference", F.count("difference").over(w).alias("n"), sd.alias("sd")).where(
        (F.col("n") >= minimum) & (F.col("sd") > 1e-9)).withColumn("sue", F.col("difference") / F.col("sd"))


def scorecard_rows(ledger: DataFrame) -> DataFrame:
    """First fill and first later exit per recommendation. Aggregates combine map-side; no self join.
    A fill at price zero has an infinite return, and none (NaN) where the exit is at zero too."""
    order = clock.arrival_key("at", "event_id")
    fills = ledger.where("event = 'FILL'").groupBy("recommendation_id").agg(F.min_by("price", order).alias("fill"), F.min("at").alias("filled_at"))
    exits = ledger.where("event = 'EXIT'").join(fills, "recommendation_id").where("at > filled_at").groupBy("recommendation_id").agg(
        F.min_by("price", order).alias("exit_price"), F.min("at").alias("exit_at"))
    x = fills.join(exits, "recommendation_id", "left")
    return x.select("*", (ieee_ratio(F.col("exit_price"), F.col("fill")) - 1).alias("ret"), F.when(F.col("exit_price").isNull(), "OPEN").otherwise("CLOSED").alias("status"))


def next_execution(signals: DataFrame, cal: DataFrame) -> DataFrame:
    """First open and first close strictly after a signal, by civil-day lookup instead of a range join."""
    days = civil(cal, 7).select("day", "on_or_after", "after")
    x = signals.withColumn("day", clock.session_of("ts")).join(F.broadcast(days), "day")
    out = []
    for kind, hour, minute in (("OPEN", 9, 30), ("CLOSE", 16, 0)):
        today = clock.new_york_instant("on_or_after", hour, minute)
        out.append(x.select("event_id", "ts", F.lit(kind).alias("kind"), F.when(today > F.col("ts"), F.col("on_or_after")).otherwise(F.col("after")).alias("fill_day")))
    return out[0].unionByName(out[1]).where("fill_day is not null")


def actions_as_events(bars: DataFrame) -> DataFrame:
    """Dividends and splits as events with content-hash identities."""
    rows = F.array_compact(F.array(
        F.when(F.col("dividend") != 0, F.struct(F.lit("DIVIDEND").alias("kind"), F.col("dividend").alias("value"))),
        F.when(F.col("split_factor") != 1, F.struct(F.lit("SPLIT").alias("kind"), F.col("split_factor").alias("value")))))
    x = bars.select("symbol", "session", F.inline(rows))
    return x.withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", "symbol", F.date_format("session", "yyyy-MM-dd"), "kind"), 256), 1, 24))
