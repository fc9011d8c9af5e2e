"""Position sizes, stops and risk lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lane name, risk fraction of equity, challenge lane.
LANES = (("core", 0.005, False), ("standard", 0.01, False), ("elevated", 0.02, False), ("challenge_5", 0.05, True), ("challenge_10", 0.10, True))
LEVERAGES = (10, 5, 2, 1)


def shares(capital: Column, price: Column, risk_per_share: Column, adv_shares: Column, risk: float = 0.005, most: float = 0.1, adv: float = 0.01) -> Column:
    """Whole shares inside the risk, capital and liquidity bounds."""
    return F.floor(F.least(capital * risk / risk_per_share, capital * most / price, adv_shares * adv))


def stop_return(entry: Column, stop: Column, first: Column, direction: str, cost_bps: float) -> Column:
    """Return at the worse of the stop and the first tradable price, after costs."""
    worse = F.least(stop, first) if direction == "LONG" else F.greatest(stop, first)
    move = worse / entry - 1
    return (move if direction == "LONG" else -move) - F.lit(cost_bps / 10_000.0)


def risk_lanes(x: DataFrame, equity: float, spread_bps: float = 10.0, fee: float = 0.01, nights: int = 5) -> DataFrame:
    """Notional from the lane's risk budget over the stressed move; the first leverage of the ladder whose
    margin survives that move; costs may take a tenth of the planned loss."""
    lanes = F.array(*[F.struct(F.lit(n).alias("lane"), F.lit(r).alias("risk"), F.lit(c).alias("challenge")) for n, r, c in LANES])
    y = x.select("*", F.inline(lanes)).withColumn("stressed", F.lit(2.0) * F.col("atr14") / F.col("px") + F.col("gap_p99"))
    y = y.withColumn("budget", F.lit(equity) * F.col("risk")).withColumn("notional", F.least(F.col("budget") / F.col("stressed"), F.lit(equity * 10.0)))
    fits = F.filter(F.array(*[F.lit(v) for v in LEVERAGES]), lambda v: (F.col("notional") / v <= F.lit(equity)) & (F.col("stressed") * v < 1.0))
    cost = F.col("notional") * F.lit(spread_bps / 10_000.0) + F.col("notional") / F.col("px") * F.lit(fee * nights)
    y = y.withColumn("leverage", F.when(F.size(fits) > 0, F.element_at(fits, 1)).otherwise(0)).withColumn("cost", cost).withColumn("planned_loss", F.col("notional") * F.col("stressed"))
    status = F.when(F.col("leverage") == 0, "NO_LEVERAGE").when(F.col("cost") > F.col("planned_loss") * 0.1, "COST_TOO_HIGH").otherwise("READY")
    return y.withColumn("status", status)
