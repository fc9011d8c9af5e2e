"""Text, date and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import clock


def canonical_symbol(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[./ ]", "-")


def digits(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1)


def tolerant_date(c: Column) -> Column:
    """First layout that parses; null when none does."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "yyyyMMdd", "MMMM d, yyyy", "MM/dd/yyyy")])


def tolerant_number(c: Column) -> Column:
    return F.regexp_replace(c, "[$, ]", "").try_cast("double")


def release_times(cal: DataFrame) -> DataFrame:
    """Next Wednesday 10:30 release, the latest release day before the close of a session's previous
    week rule, and the Friday 15:30 publication of the last Tuesday's report."""
    wed = F.next_day(F.date_sub("session", 1), "WED")
    tue = F.date_sub(F.next_day("session", "TUE"), 7)
    return cal.select(
        "session", clock.stamp(clock.new_york_instant(wed, 10, 30)).alias("release"),
        F.when(wed == F.col("session"), wed).otherwise(F.date_sub(wed, 7)).alias("latest_before"),
        clock.stamp(clock.new_york_instant(F.date_add(tue, 3), 15, 30)).alias("report_release"))


def holding_flags(x: DataFrame) -> DataFrame:
    """Does a holding span a weekend, and does it contain a Wednesday release?"""
    nxt = F.next_day(F.date_sub("session", 1), "WED")
    return x.select("session", "exit_session", (F.trunc("session", "WEEK") != F.trunc("exit_session", "WEEK")).alias("crosses_weekend"),
                    (nxt <= F.col("exit_session")).alias("in_release_window"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one length; null where either does not vary."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    times = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
    n, s, t = F.size(a), total(a), total(b)
    spread = (n * total(times(a, a)) - s * s) * (n * total(times(b, b)) - t * t)
    return (n * total(times(a, b)) - s * t) / F.nullif(F.sqrt(F.greatest(spread, F.lit(0.0))), F.lit(0.0))


def similarity(corr: Column | None, same: Column, a: Column, b: Column) -> Column:
    """Mean of the available parts: correlation, same group, cosine of exposure vectors."""
    mul = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = mul(a, b) / F.nullif(F.sqrt(mul(a, a) * mul(b, b)), F.lit(0.0))
    parts = [same.cast("double"), cos] + ([corr] if corr is not None else [])
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total / len(parts)
