"""Month-end cohorts and their daily paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crosssec import side_ranks


def cohort_members(month_rows: DataFrame, value: str, k: int, minimum: int) -> DataFrame:
    top, bottom, n = side_ranks(value)
    x = month_rows.where(F.col(value).isNotNull()).select("symbol", "session", "pos", top.alias("a"), bottom.alias("b"), n.alias("n"))
    side = F.when(F.col("a") <= k, "TOP").when(F.col("b") <= k, "BOTTOM")
    return x.where(F.col("n") >= minimum).select(F.col("session").alias("cohort"), "symbol", "pos", side.alias("side")).where("side is not null")


def cohort_paths(members: DataFrame, r: DataFrame, horizon: int) -> DataFrame:
    """Daily returns of the ``horizon`` sessions after formation."""
    want = members.select("cohort", "symbol", "side", "pos", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day_offset"))
    want = want.withColumn("pos", F.col("pos") + F.col("day_offset"))
    return want.join(r.where("ret is not null").select("symbol", "pos", "ret"), ["symbol", "pos"])


def form_paths(paths: DataFrame, financing: DataFrame, last_pos: int, horizon: int, forms=("LONG_ONLY", "SHORT_ONLY", "LONG_SHORT"),
               leverages=(1.0, 1.5, 2.0), cost_bps: float = 5.0) -> DataFrame:
    """Levered daily path of every cohort, portfolio form and leverage, net of financing and entry/exit costs.

    One row per (cohort, day) carries both sides, so forms and leverages are column expressions. Cohorts
    whose horizon runs past the sample are left out.
    """
    day = paths.where(F.col("pos") - F.col("day_offset") + horizon <= last_pos).groupBy("cohort", "day_offset", "pos").agg(
        F.avg(F.when(F.col("side") == "TOP", F.col("ret"))).alias("top"), F.avg(F.when(F.col("side") == "BOTTOM", F.col("ret"))).alias("bottom"))
    day = day.join(financing, "pos", "left")
    raw = {"LONG_ONLY": F.col("top"), "SHORT_ONLY": -F.col("bottom"), "LONG_SHORT": (F.col("top") - F.col("bottom")) / 2}
    edge = F.when(F.col("day_offset").isin(1, horizon), F.lit(cost_bps / 10_000.0)).otherwise(0.0)
    rows = F.array(*[
        F.struct(F.lit(f).alias("form"), F.lit(lev).alias("leverage"),
                 (F.lit(lev) * F.coalesce(raw[f], F.lit(0.0)) - F.lit(max(lev - 1.0, 0.0)) * F.coalesce("financing", F.lit(0.0)) - edge * lev).alias("r"))
        for f in forms for lev in leverages])
    return day.select("cohort", "day_offset", F.inline(rows))


def cohort_outcomes(levered: DataFrame) -> DataFrame:
    """Compounded outcome per cohort and whether equity ever reached zero."""
    w = Window.partitionBy("cohort", "form", "leverage").orderBy("day_offset").rowsBetween(Window.unboundedPreceding, 0)
    x = levered.withColumn("eq", F.product(F.col("r") + 1).over(w))
    return x.groupBy("cohort", "form", "leverage").agg(
        (F.product(F.col("r") + 1) - 1).alias("outcome"), F.bool_or(F.col("eq") <= 0).alias("bankrupt"), F.min(F.col("eq") - 1).alias("worst"))
