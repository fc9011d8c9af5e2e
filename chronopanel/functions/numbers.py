"""Counter-based numbers: the same key gives the same number on every executor and in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_u32(*parts: Column | str | int) -> Column:
    """First 32 bits of md5 over ':'-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return hashed_u32(*parts) / F.lit(4294967296.0)


def draw_index(n: Column, *parts: Column | str | int) -> Column:
    """Integer in [0, n)."""
    return F.floor(uniform(*parts) * n).cast("bigint")


def ieee_ratio(above: Column, below: Column) -> Column:
    """The quotient of two doubles as IEEE 754 has it: infinite or NaN over zero, where Spark's own division raises."""
    return F.when(below == 0, above * F.pow(below, F.lit(-1.0))).otherwise(F.try_divide(above, below))
