"""Forward labels, event-study returns and the close-time model frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import compounded, framed, over_sessions, shifted


def forward_label(b: DataFrame, cal: DataFrame, horizon: int = 5, cost_bps: float = 8.0, borrow: float = 0.003) -> DataFrame:
    """Return from the next close over ``horizon`` sessions, hedged with today's betas, net of costs.

    The market leg is a table by session and joins in; the peer leg needs a value on every session.
    """
    one = W.partitionBy(F.lit(1)).orderBy("pos").rangeBetween(2, horizon + 1)
    market = b.select("pos", "mkt").distinct()
    leg = market.select("pos", F.when(F.count("mkt").over(one) == horizon, F.product(F.col("mkt") + 1).over(one) - 1).alias("market_leg"))
    ends = cal.select((F.col("pos") - horizon - 1).alias("pos"), F.col("session").alias("label_end"))
    x = b.join(leg, "pos", "left").join(ends, "pos", "left")
    x = x.select(
        "*",
        (shifted("px", -horizon - 1) / shifted("px", -1) - 1).alias("forward"),
        compounded("peer", horizon, end=horizon + 1).alias("sector_leg"),
    )
    charge = cost_bps / 10000.0 + borrow * horizon / 365.0
    return x.withColumn(
        "label",
        F.col("forward") - F.col("beta_market") * F.col("market_leg") - F.col("beta_sector") * F.col("sector_leg") - F.lit(charge),
    )


def event_returns(x: DataFrame, flag: str, horizons, cal: DataFrame) -> DataFrame:
    """Enter at the next open, leave at the close ``h`` sessions on; the row is stamped with the exit session."""
    legs = F.array(*[
        F.struct(F.lit(h).alias("horizon"), (F.col("pos") + h).alias("exit_pos"),
                 (shifted("px", -h) / shifted("open_adj", -1) - 1).alias("ret"))
        for h in horizons
    ])
    out = x.select("symbol", "pos", flag, legs.alias("legs")).where(flag).select("symbol", F.inline("legs"))
    days = cal.select(F.col("pos").alias("exit_pos"), "session")
    return out.where("ret is not null").join(days, "exit_pos")


def past_return(k: int) -> Column:
    return F.col("px") / shifted("px", k) - 1


def model_features(r: DataFrame) -> DataFrame:
    """Features known at the close; one window partitioning serves all of them."""
    gap = F.abs(F.col("open_adj") / F.col("px1") - 1)
    body = F.abs(F.col("px") / F.col("open_adj") - 1)
    return r.select(
        "*",
        F.col("ret").alias("r1"),
        *[past_return(k).alias(f"r{k}") for k in (2, 3, 5, 10, 20)],
        (F.col("volume") / framed(F.avg("volume"), "volume", 20, end=-1) - 1).alias("abnormal_volume"),
        (gap / (gap + body + F.lit(1e-12))).alias("gap_fraction"),
        (framed(F.stddev_samp("ret"), "ret", 5) / framed(F.stddev_samp("ret"), "ret", 20)).alias("vol_expansion"),
        F.log1p(F.avg(F.col("px") * F.col("volume")).over(over_sessions(-20, -1))).alias("log_adv"),
        ((F.col("px") - F.col("low_adj")) / F.nullif(F.col("high_adj") - F.col("low_adj"), F.lit(0.0))).alias("range_pos"),
    )
