"""Research panel preparation: range, availability and price gates, adjusted prices, returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock


def research_panel(r: DataFrame, start: str, end: str) -> DataFrame:
    """Fails on a bar that is late for the next open or violates its own range; prices are adjusted."""
    w = W.partitionBy("symbol").orderBy("session")
    nxt = F.lead("session").over(w)
    late = F.coalesce((F.col("available_at") >= F.lead("event_time").over(w)) | (F.col("available_at") >= clock.new_york_instant(nxt, 9, 30)), F.lit(False))
    tol = F.lit(1e-12)
    broken = (F.col("high_adj") < F.greatest("open_adj", "px") * (F.lit(1.0) - tol)) | (F.col("low_adj") > F.least("open_adj", "px") * (F.lit(1.0) + tol))
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    x = r.where((F.col("session") >= lo) & (F.col("session") < hi))
    x = x.withColumn("fault", F.when(late, "availability").when(broken, "range"))
    ok = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("bar gate: "), "fault"))).otherwise(F.lit(True)).cast("boolean")
    return x.where(ok).select("symbol", "session", F.col("open_adj").alias("open"), F.col("high_adj").alias("high"), F.col("low_adj").alias("low"),
                              F.col("px").alias("close"), "volume", F.when(F.col("session") > lo, F.col("ret")).alias("ret"))
