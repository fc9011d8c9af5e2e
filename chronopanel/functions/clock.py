"""The two clocks: New York wall time to UTC instants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def new_york_instant(day: str | Column, hour: int, minute: int = 0) -> Column:
    """UTC instant of a New York wall time on a civil date."""
    wall = F.timestamp_seconds(F.unix_date(col(day)).cast("bigint") * 86400 + hour * 3600 + minute * 60)
    return F.to_utc_timestamp(wall, NEW_YORK)


def new_york_wall(instant: str | Column) -> Column:
    return F.from_utc_timestamp(col(instant), NEW_YORK)


def session_of(instant: str | Column) -> Column:
    """New York civil date of an instant."""
    return F.to_date(new_york_wall(instant))


def market_close(day: str | Column) -> Column:
    return new_york_instant(day, 16)


def bar_available(day: str | Column) -> Column:
    return new_york_instant(day, 16, 15)


def stamp(instant: str | Column) -> Column:
    """Readable UTC text, the same in every engine."""
    return F.date_format(col(instant), "yyyy-MM-dd HH:mm:ss")


def arrival_key(instant: str | Column, tie: str | Column) -> Column:
    """Instant and tie-breaker as one decimal: fixed-width, so first/last-by aggregates hash instead of sort.
    Instants are 2e19 apart, so any bigint may break ties."""
    return F.unix_micros(col(instant)).cast("decimal(20,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") + col(tie).cast("decimal(19,0)")


def clock_minutes(instant: str | Column) -> Column:
    wall = new_york_wall(instant)
    return F.hour(wall) * 60 + F.minute(wall)
