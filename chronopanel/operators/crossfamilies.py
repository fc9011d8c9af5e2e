"""Declared cross-sectional families as trials: ranked features, calendar gates, cohorts, both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features as FE
from .crosssec import decile_weights
from .frames import shifted
from .trials import calendar_predicates

# Sessions that a rank is held (momentum follows the month instead), gated families and their gates.
HELD = {"momentum_12_1": 21, "reversal_5d": 5, "low_volatility": 21, "high_52w_proximity": 21,
        "amihud_illiquidity": 21, "max_lottery": 21, "overnight_intraday_gap": 5, "etf_relative_reversal": 5}
MONTHLY = "momentum_12_1"
GATED = ("momentum_12_1", "reversal_5d")
GATED_HELD = 5
GATES = {"weekday": "4", "turn_of_month": "TOM", "month_end": "WINDOW", "quarter_end": "WINDOW"}
SIDES = {"LONG": 1.0, "SHORT": -1.0}
LAG = 2  # a rank of one close trades at the next and earns from there


def scores(r: DataFrame) -> DataFrame:
    """(family, symbol, pos, score) of every declared feature where it is known; funds alone rank in their own family."""
    x = FE.canonical_features(r)
    funds = F.when(F.col("asset_type") == "etf", -(F.col("px") / shifted("px", 21) - 1))
    named = {"momentum_12_1": F.col("momentum"), "reversal_5d": F.col("reversal"), "low_volatility": F.col("low_volatility"), "high_52w_proximity": F.col("high_proximity"),
             "amihud_illiquidity": FE.amihud(), "max_lottery": FE.max_lottery(), "overnight_intraday_gap": FE.overnight_gap(), "etf_relative_reversal": funds}
    rows = F.array(*[F.struct(F.lit(n).alias("family"), c.alias("score")) for n, c in named.items()])
    return x.select("symbol", "pos", rows.alias("_f")).select("symbol", "pos", F.inline("_f")).where("score is not null")


def gate_sessions(flags: DataFrame) -> DataFrame:
    """(gate, pos) of the sessions on which a declared gate is open."""
    rows = calendar_predicates(flags)
    open_ = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])
    return rows.where(F.col("value") == open_[F.col("family")]).select(F.concat_ws("=", "family", "value").alias("gate"), "pos")


def family_entries(ranked: DataFrame, flags: DataFrame) -> DataFrame:
    """(trial, symbol, pos, weight, held): weights of a rank and the number of sessions that they stand.

    A rank of a daily family is one of ``held`` overlapping cohorts; momentum stands from the first session of a month
    to the next one's; a gated rank acts only if its first earning session passes the gate.
    """
    w = decile_weights(ranked, "score", by=("family", "pos")).where("weight <> 0").select("family", "symbol", "pos", "weight")
    held = F.create_map(*[F.lit(x) for pair in HELD.items() for x in pair])
    daily = w.where(F.col("family") != MONTHLY).select("family", F.lit("ANY").alias("gate"), "symbol", "pos", (F.col("weight") / held[F.col("family")]).alias("weight"), held[F.col("family")].alias("held"))
    one = W.orderBy("pos")  # a row per month
    last = flags.agg((F.max("pos") + 1).alias("_end"))
    firsts = flags.groupBy(F.trunc("session", "MM").alias("_m")).agg(F.min("pos").alias("pos")).join(last).select(
        "pos", (F.coalesce(F.lead("pos").over(one), F.col("_end")) - F.col("pos")).cast("int").alias("held"))
    monthly = w.where(F.col("family") == MONTHLY).join(firsts, "pos").select("family", F.lit("ANY").alias("gate"), "symbol", "pos", "weight", "held")
    gates = gate_sessions(flags).select("gate", (F.col("pos") - LAG).alias("pos"))
    gated = w.where(F.col("family").isin(*GATED)).join(gates, "pos").select("family", "gate", "symbol", "pos", (F.col("weight") / float(GATED_HELD)).alias("weight"), F.lit(GATED_HELD).alias("held"))
    x = daily.unionByName(monthly).unionByName(gated)
    sides = F.array(*[F.struct(F.lit(d).alias("side"), F.lit(s).alias("sign")) for d, s in SIDES.items()])
    x = x.select("*", F.inline(sides))
    return x.select(F.concat_ws("|", "family", "gate", "side").alias("trial"), "symbol", "pos", (F.col("weight") * F.col("sign")).alias("weight"), "held")


def standing_positions(entries: DataFrame, lag: int = LAG) -> DataFrame:
    """(trial, symbol, pos, weight, previous) where each entry stands for its own number of sessions."""
    x = entries.select("trial", "symbol", "pos", "weight", "held", F.explode(F.sequence(F.lit(0), F.col("held"))).alias("k"))
    today = F.when(F.col("k") < F.col("held"), F.col("weight")).otherwise(0.0)
    before = F.when(F.col("k") > 0, F.col("weight")).otherwise(0.0)
    x = x.select("trial", "symbol", (F.col("pos") + lag + F.col("k")).alias("pos"), today.alias("w"), before.alias("p"))
    return x.groupBy("trial", "symbol", "pos").agg(F.sum("w").alias("weight"), F.sum("p").alias("previous"))
