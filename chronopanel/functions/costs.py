"""Trading-cost expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Fixed values of the baseline cost model (basis points unless said)."""

    capital: float = 100_000.0
    commission: float = 0.0
    etf_spread: float = 1.0
    equity_spread: float = 3.0
    base_slippage: float = 1.0
    impact: float = 10.0
    impact_cap: float = 50.0
    borrow_annual: float = 0.003
    turnover_penalty: float = 1.0
    unknown_adv: float = 100_000_000.0


BASE = Costs()


def spread_bps(asset_type: Column, c: Costs = BASE) -> Column:
    return F.when(asset_type == "etf", F.lit(c.etf_spread)).otherwise(F.lit(c.equity_spread))


def impact_bps(order_dollars: Column, adv: Column, c: Costs = BASE) -> Column:
    share = order_dollars / adv
    return F.least(F.lit(c.base_slippage) + F.lit(c.impact) * F.sqrt(F.greatest(share, F.lit(0.0))), F.lit(c.impact_cap))


def trade_bps(order_dollars: Column, adv: Column, asset_type: Column, fills: int = 2, holding_days: Column | None = None,
              short: Column | None = None, c: Costs = BASE) -> Column:
    """Cost of one complete trade in basis points."""
    total = spread_bps(asset_type, c) * (fills / 2.0) + impact_bps(order_dollars, adv, c) * float(fills)
    total = total + F.lit(c.commission * fills * 10_000.0) / order_dollars + F.lit(c.turnover_penalty)
    if holding_days is not None and short is not None:
        total = total + F.when(short, F.lit(c.borrow_annual * 10_000.0 / 365.0) * holding_days).otherwise(0.0)
    return total


def daily_cost(weight: Column, previous: Column, adv: Column, asset_type: Column, multiplier: float | Column = 1.0,
               scale: float | Column = 1.0, spread: Column | None = None, c: Costs = BASE) -> Column:
    """Cost fraction of one name on one day: traded weight pays half the spread, impact and the turnover
    penalty; a held short pays borrow."""
    traded = F.abs(weight - previous)
    capital = F.lit(c.capital) * scale
    rate = (spread if spread is not None else spread_bps(asset_type, c)) / 2.0 + impact_bps(traded * capital, adv, c) + F.lit(c.turnover_penalty)
    borrow = F.greatest(-weight, F.lit(0.0)) * F.lit(c.borrow_annual / 365.0 * 10_000.0)
    fee = F.when(traded > 0, F.lit(c.commission) / capital).otherwise(0.0)
    return ((traded * rate + borrow) / 10_000.0 + fee) * multiplier


def flip_fraction(weight: Column, adv: Column, asset_type: Column, c: Costs = BASE) -> Column:
    """Cost fraction of one fill of a given weight."""
    return weight * (spread_bps(asset_type, c) / 2.0 + impact_bps(weight * F.lit(c.capital), adv, c) + F.lit(c.turnover_penalty)) / 10_000.0
