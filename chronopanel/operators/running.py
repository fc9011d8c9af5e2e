"""Running totals and maxima over keys of any size.

A window per key would put a whole key into one task. Here a key is cut into time buckets: bucket totals
are aggregated first (map-side), swept as a table of one row per (key, bucket), and added to windows that
only span one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], sums: dict[str, str] | None = None,
            maxima: dict[str, str] | None = None) -> DataFrame:
    """Adds inclusive running sums and maxima (out name -> input column). ``bucket`` must be monotone in
    ``order``."""
    sums, maxima = sums or {}, maxima or {}
    jobs = [(o, c, F.sum) for o, c in sums.items()] + [(o, c, F.max) for o, c in maxima.items()]
    totals = df.groupBy(*keys, bucket).agg(*[fn(c).alias(f"_t_{o}") for o, c, fn in jobs])
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, bucket, *[fn(f"_t_{o}").over(before).alias(f"_c_{o}") for o, c, fn in jobs])
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = df.join(carried, [*keys, bucket])
    for o, c, fn in jobs:
        here = fn(c).over(inside)
        x = x.withColumn(o, F.coalesce(F.col(f"_c_{o}"), F.lit(0.0)) + here if fn is F.sum else F.greatest(F.col(f"_c_{o}"), here))
    return x.drop(*[f"_c_{o}" for o, _, _ in jobs])
