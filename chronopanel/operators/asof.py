"""As-of joins: each left row meets the nearest right row on one side of its clock.

Both sides are unioned, ordered inside (key, time bucket) and swept once with a last-non-null window.
A bucket starts from the newest right row of the earlier buckets of its key, which a pre-aggregated
table (one row per key and bucket) supplies. A key that holds a third of all rows is therefore spread
over its buckets instead of being swept by one task, and the answer stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str],
              direction: str = "backward", strict: bool = False, tolerance: float | None = None,
              bucket_seconds: int = 86400) -> DataFrame:
    """Left rows plus ``take`` columns (and ``matched_at``) of the nearest right row.

    ``backward`` takes the latest right row at or before the left clock, ``forward`` the earliest at or
    after; ``strict`` excludes equality. ``tolerance`` is in seconds. Clocks are timestamps; right rows
    sharing a key and clock resolve to the largest ``take`` values.
    """
    sign = 1 if direction == "backward" else -1
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * sign
    bucket = F.floor(F.col("_t") / (bucket_seconds * 1000000)).cast("bigint")
    hit = F.struct(F.col("_t").alias("t"), *[F.col(c) for c in take])
    empty = F.lit(None)

    r = right.select(*by, micros(right_on).alias("_t"), *take).where("_t is not null")
    r = r.select(*by, "_t", bucket.alias("_b"), hit.alias("_hit"))
    # One newest row per (key, bucket), then carried to the later buckets that need it.
    newest = r.groupBy(*by, "_b").agg(F.max("_hit").alias("_top"))
    l0 = left.withColumn("_t", micros(left_on)).withColumn("_b", bucket)
    need = l0.select(*by, "_b").distinct().select("*", empty.cast(newest.schema["_top"].dataType).alias("_top"))
    sweep = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        newest.unionByName(need).groupBy(*by, "_b").agg(F.max("_top").alias("_top"))
        .select(*by, "_b", F.last("_top", True).over(sweep).alias("_hit"))
        .where("_hit is not null")
    )
    first, second = (0, 1) if not strict else (1, 0)
    names = [c for c in left.columns]
    blank = [empty.cast(left.schema[c].dataType).alias(c) for c in names if c not in by]
    kind = newest.schema["_top"].dataType
    rows = (
        l0.select(*names, "_t", "_b", F.lit(second).alias("_o"), empty.cast(kind).alias("_hit"), F.lit(True).alias("_left"))
        .unionByName(r.select(*by, *blank, "_t", "_b", F.lit(first).alias("_o"), "_hit", F.lit(False).alias("_left")))
        .unionByName(carried.select(*by, *blank, F.lit(-(2**62)).cast("bigint").alias("_t"), "_b", F.lit(-1).alias("_o"), "_hit",
                                    F.lit(False).alias("_left")))
    )
    w = W.partitionBy(*by, "_b").orderBy("_t", "_o", "_hit").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_m", F.last("_hit", True).over(w)).where("_left")
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.col("_t") - F.col("_m.t") <= int(tolerance * 1000000), F.col("_m")))
    return out.select(
        *names, *[F.col(f"_m.{c}").alias(c) for c in take],
        F.timestamp_micros(F.col("_m.t") * sign).alias("matched_at"),
    )
