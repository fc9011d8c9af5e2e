"""Trial streams: selected names to executed positions to daily gross, cost and net.

Positions are never filled into a (trial x session x symbol) cube. Each selected entry is expanded to
the ``holding`` sessions it is held plus one closing row that carries yesterday's weight, and one
aggregation by (trial, symbol, session) gives today's and yesterday's position side by side. Its size
is entries x (holding + 1). Market data joins in by (symbol, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.costs import daily_cost
from .crosssec import top_k_entries


def reversal_entries(signals: DataFrame, ks=(1, 2, 3, 5, 8), variants=("raw", "sector_neutral", "residual")) -> DataFrame:
    """Breadth x signal x side grid: one ranking per signal, all breadths and sides from it."""
    long = signals.select("symbol", "session", "pos", F.inline(F.array(*[
        F.struct(F.lit(v).alias("signal"), F.col(v).alias("score")) for v in variants])))
    picks = top_k_entries(long, "score", ks, by=("signal", "session"))
    return picks.select(
        F.concat_ws("|", "signal", F.col("k").cast("string"), "side").alias("trial"), "symbol", "pos", "weight")


def positions(entries: DataFrame, holding: int, lag: int, last_pos: DataFrame | None = None) -> DataFrame:
    """(trial, symbol, pos, weight, previous) of overlapping cohorts held ``holding`` sessions."""
    k = F.explode(F.sequence(F.lit(0), F.lit(holding))).alias("k")
    x = entries.select("trial", "symbol", "pos", (F.col("weight") / float(holding)).alias("w"), k)
    x = x.select(
        "trial", "symbol", (F.col("pos") + lag + F.col("k")).alias("pos"),
        F.when(F.col("k") < holding, F.col("w")).otherwise(0.0).alias("w"),
        F.when(F.col("k") > 0, F.col("w")).otherwise(0.0).alias("p"))
    return x.groupBy("trial", "symbol", "pos").agg(F.sum("w").alias("weight"), F.sum("p").alias("previous"))


def evaluate(pos: DataFrame, market: DataFrame, cal: DataFrame, multiplier: float = 1.0, scale: float = 1.0, returns_at: str = "pos") -> DataFrame:
    """Daily gross, cost, turnover and net of every trial that traded; idle sessions are zero rows. `returns_at` names
    the column with the session whose returns a position earns."""
    x = pos.join(market.select("symbol", F.col("pos").alias(returns_at), "ret"), ["symbol", returns_at], "left").join(
        market.select("symbol", F.col("pos"), "adv20"), ["symbol", "pos"], "left")
    names = market.select("symbol", "asset_type").distinct()
    x = x.join(names, "symbol")
    cost = daily_cost(F.col("weight"), F.col("previous"), F.coalesce("adv20", F.lit(1e8)), F.col("asset_type"), multiplier, scale)
    daily = x.groupBy("trial", "pos").agg(
        F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0))).alias("gross"),
        F.sum(cost).alias("cost"), (F.sum(F.abs(F.col("weight") - F.col("previous"))) / 2).alias("turnover"),
        F.sum(F.abs("weight")).alias("exposure"))
    days = cal.agg(F.array_sort(F.collect_list(F.struct("pos", "session"))).alias("days"))
    frame = pos.select("trial").distinct().join(F.broadcast(days)).select("trial", F.inline("days"))
    zero = F.lit(0.0)
    out = frame.join(daily, ["trial", "pos"], "left").select(
        "trial", "pos", "session", *[F.coalesce(c, zero).alias(c) for c in ("gross", "cost", "turnover", "exposure")])
    return out.withColumn("net", F.col("gross") - F.col("cost"))
