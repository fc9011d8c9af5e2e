"""Window frames counted in sessions.

A panel row carries ``pos``, the position of its session in the calendar. Range frames over ``pos``
see exactly the sessions a dense matrix would see, without filling the matrix first: a missing bar
is a missing row and leaves the frame short, and the exact-count guard then gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "symbol"
ORDER = "pos"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def over_sessions(start: int | None, end: int | None, key: str = KEY, order: str = ORDER):
    lo = W.unboundedPreceding if start is None else start
    hi = W.unboundedFollowing if end is None else end
    return W.partitionBy(key).orderBy(order).rangeBetween(lo, hi)


def shifted(c: str | Column, k: int, key: str = KEY, order: str = ORDER) -> Column:
    """Value exactly ``k`` sessions earlier (later when negative); null if there is no row there."""
    return F.max(col(c)).over(over_sessions(-k, -k, key, order))


def framed(agg: Column, guard: str | Column | None, width: int, end: int = 0, key: str = KEY, order: str = ORDER,
           minimum: int | None = None) -> Column:
    """``agg`` over ``width`` sessions ending ``end`` sessions from here; null unless the frame holds
    ``minimum`` (default: all) non-null guard values."""
    frame = over_sessions(end - width + 1, end, key, order)
    value = agg.over(frame)
    if guard is None:
        return value
    return F.when(F.count(col(guard)).over(frame) >= (width if minimum is None else minimum), value)


def compounded(c: str | Column, width: int, end: int = 0, key: str = KEY, order: str = ORDER) -> Column:
    """Product of (1 + x) over an exactly full frame, minus one."""
    x = col(c)
    frame = over_sessions(end - width + 1, end, key, order)
    return F.when(F.count(x).over(frame) == width, F.product(x + 1.0).over(frame) - 1.0)
