"""Sizes and specs of the fixed trial families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .crossfamilies import GATED, GATES, HELD, SIDES
from .trials import hypothesis_grid

# The declared axes of each family.
REVERSAL = {"signal": ("raw", "sector_neutral", "residual"), "breadth": (1, 2, 3, 5, 8), "side": ("LONG", "SHORT")}
VETO = {"veto": ("NONE", "EARNINGS_WINDOW", "NEGATIVE_GUIDANCE", "ACTIVE_HALT", "GAP_PERCENT_0.03", "GAP_PERCENT_0.05", "GAP_PERCENT_0.08", "GAP_ATR_1.5", "GAP_ATR_2.0", "GAP_ATR_2.5")}
LOSS_AWARE = {"horizon": ("MONTHLY_21", "YEARLY_252"), "signal": ("MOMENTUM_252_SKIP_21", "REVERSAL_5", "LOW_VOLATILITY_252", "HIGH_PRICE_PROXIMITY_252", "EQUAL_RANK_COMPOSITE"),
              "form": ("LONG_ONLY", "SHORT_ONLY", "MARKET_NEUTRAL"), **VETO, "leverage": (1.0, 1.5, 2.0)}
OVERNIGHT = {"instrument": ("A", "B"), "condition": ("ANY", "turn_of_month=TOM", "month_end_window=WINDOW", "weekday=FRI", "market_above_sma200", "market_vol_high_tercile"), "side": ("LONG", "SHORT")}


def specs(spark: SparkSession, family: str, axes: dict) -> DataFrame:
    """Every combination of a family's axes as (family, spec)."""
    x = spark.range(1).select(F.lit(family).alias("family"))
    for name, values in axes.items():
        x = x.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return x.select("family", F.concat_ws("|", *[F.col(n).cast("string") for n in axes]).alias("spec"))


def calendar_specs(spark: SparkSession) -> DataFrame:
    return hypothesis_grid(spark).select(F.lit("CALENDAR").alias("family"), F.col("trial").alias("spec"))


def declared(spark: SparkSession) -> DataFrame:
    """(family, spec) of every trial that is declared whatever the data hold."""
    gates = tuple("=".join(g) for g in GATES.items())
    x = calendar_specs(spark)
    for family, axes in (("REVERSAL", REVERSAL), ("LOSS_AWARE", LOSS_AWARE), ("VETO", VETO), ("OVERNIGHT", OVERNIGHT),
                         ("CROSS_SECTIONAL", {"signal": tuple(HELD), "gate": ("ANY",), "side": tuple(SIDES)}),
                         ("COMBINATION", {"signal": GATED, "gate": gates, "side": tuple(SIDES)})):
        x = x.unionByName(specs(spark, family, axes))
    return x
