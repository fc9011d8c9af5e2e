"""Studies and decisions on traded proxies: their own bars, their peers, and reference series as they were known.

Every look-back counts the proxy's own sessions, so a proxy that did not trade has no row and no stale value. The rows
of a symbol are bounded by the calendar; symbols are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from .asof import asof_join
from .expanding import expanding_quantiles
from .filters import reasons

# The declared signals, the sessions that a trial of each horizon ends after its signal, the series.
SIGNALS = (
    "trend_20", "trend_60", "trend_200", "momentum_5", "momentum_20", "momentum_60", "reversal_1", "reversal_5",
    "brent_wti_relative_20", "energy_equity_confirmation_5", "ovx_below_expanding_p90", "dollar_down_20",
    "eia_crude_draw", "eia_cushing_draw", "cftc_managed_money_rising", "weekday_tuesday",
    "composite_trend_confirmation", "composite_full",
)
HORIZONS = {"INTRADAY": 1, "SWING_1D": 1, "SWING_3D": 3, "SWING_5D": 5}
SERIES = ("wti", "brent", "ovx", "dollar", "crude", "cushing", "managed")
ROUND_TRIP = 0.0020


def _own(*key: str):
    """Rows of a key in the order of their sessions."""
    return W.partitionBy(*(key or ("symbol",))).orderBy("session")


def known_series(cal: DataFrame, observations: DataFrame, names=SERIES) -> DataFrame:
    """One column per series: on each session the newest value that could be used at its close.

    ``observations`` is (series, value, available_at); null values are no observations.
    """
    asked = cal.select("session", clock.market_close("session").alias("decision_at"), F.explode(F.array(*[F.lit(n) for n in names])).alias("series"))
    seen = asof_join(asked, observations.where("value is not null"), ["series"], "decision_at", "available_at", ["value"], bucket_seconds=86400 * 366)
    return seen.groupBy("session").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])


def _change(value: str | Column, rows: int, *key: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value / F.nullif(F.lag(value, rows).over(_own(*key)), F.lit(0.0)) - 1


def peers_rising(p: DataFrame, peers: DataFrame, rows: int = 5) -> DataFrame:
    """(symbol, session, rising): every declared peer is above its price of ``rows`` sessions of the proxy ago.

    A peer without a price on either session is not rising; a proxy without peers is never confirmed.
    """
    other = p.select(F.col("symbol").alias("peer"), "session", F.col("px").alias("_peer"))
    pair = p.select("symbol", "session").join(peers, "symbol").join(other, ["peer", "session"], "left")
    up = F.coalesce(_change("_peer", rows, "symbol", "peer") > 0, F.lit(False))
    return pair.select("symbol", "session", up.alias("_up")).groupBy("symbol", "session").agg(F.every("_up").alias("rising"))


def signal_frame(p: DataFrame, peers: DataFrame, known: DataFrame) -> DataFrame:
    """Bars with one boolean column per declared signal; what cannot be decided yet is false."""
    x = p.select("symbol", "session", "pos", "px", "open_adj").join(known, "session", "left").join(peers_rising(p, peers), ["symbol", "session"], "left")
    x = expanding_quantiles(x, "ovx", {"_ovx_high": 0.90}, 252)
    px = F.col("px")

    def above(width: int) -> Column:
        frame = _own().rowsBetween(1 - width, 0)
        return F.when(F.count(px).over(frame) == width, px > F.avg(px).over(frame))

    def step(name: str) -> Column:
        return F.col(name) - F.lag(name).over(_own())

    spots = (F.col("wti") > 0) & (F.col("brent") > 0)
    own = {
        "trend_20": above(20), "trend_60": above(60), "trend_200": above(200),
        "momentum_5": _change(px, 5) > 0, "momentum_20": _change(px, 20) > 0, "momentum_60": _change(px, 60) > 0,
        "reversal_1": _change(px, 1) < 0, "reversal_5": _change(px, 5) < 0,
        "brent_wti_relative_20": (_change("brent", 20) > _change("wti", 20)) & spots,
        "energy_equity_confirmation_5": F.col("rising"),
        "ovx_below_expanding_p90": F.col("ovx") < F.col("_ovx_high"),
        "dollar_down_20": _change("dollar", 20) < 0,
        "eia_crude_draw": step("crude") < 0, "eia_cushing_draw": step("cushing") < 0,
        "cftc_managed_money_rising": step("managed") > 0,
        "weekday_tuesday": F.weekday("session") == 1,
    }
    x = x.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in own.items()})
    c = F.col
    return x.withColumns({
        "composite_trend_confirmation": c("trend_60") & c("energy_equity_confirmation_5"),
        "composite_full": c("momentum_20") & c("brent_wti_relative_20") & c("energy_equity_confirmation_5") & c("ovx_below_expanding_p90") & c("dollar_down_20"),
    })


def proxy_trials(frame: DataFrame, round_trip: float = ROUND_TRIP) -> DataFrame:
    """(symbol, signal, horizon, pos, gross, net) of every declared trial: in at the next open, out at a later close.

    ``pos`` is the position of the exit; a trial that would leave after the last bar has no row.
    """
    entry = F.lead("open_adj").over(_own())
    ends = []
    for name, k in HORIZONS.items():
        exit_px = F.lead("px", k).over(_own())
        gross = F.when((entry > 0) & (exit_px > 0), exit_px / entry - 1)
        ends.append(F.struct(F.lit(name).alias("horizon"), F.lead("pos", k).over(_own()).alias("pos"), gross.alias("gross")))
    on = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in SIGNALS]))
    x = frame.select("symbol", on.alias("_on"), F.array(*ends).alias("_ends"))
    x = x.select("symbol", F.explode("_on").alias("signal"), "_ends").select("symbol", "signal", F.inline("_ends"))
    return x.where("gross is not null").withColumn("net", F.col("gross") - F.lit(round_trip))


def composite_votes(frame: DataFrame) -> DataFrame:
    """Last row of every proxy: four votes for a long position, three of them are enough.

    The trend vote compares the price with the mean of 61 own sessions, the momentum vote with the price of 20 before.
    """
    w = _own().rowsBetween(-60, 0)
    x = frame.withColumns({
        "trend_vote": F.when(F.count("px").over(w) == 61, F.col("px") > F.avg("px").over(w)),
        "momentum_vote": _change("px", 20) > 0,
        "five": _change("px", 5),
        "dollar_vote": _change("dollar", 20) <= 0,
        "volatile": F.col("ovx") > F.col("_ovx_high"),
    })
    names = ["session", "pos", "five", "trend_vote", "momentum_vote", "dollar_vote", "volatile", "ovx", "dollar"]
    return x.groupBy("symbol").agg(F.max_by(F.struct(*names), "session").alias("r")).select("symbol", "r.*")


def agreement(votes: DataFrame, groups: DataFrame, needed: int = 4) -> DataFrame:
    """(group, symbol and the columns of votes, n_proxies, rising, same_session, agreement) for the proxies of a group."""
    x = groups.join(votes, "symbol", "left")
    state = x.groupBy("group").agg(
        F.count("five").alias("n_proxies"), F.count_if(F.col("five") > 0).alias("rising"), (F.count_distinct("session") == 1).alias("same_session"))
    bull, bear = F.lit(needed - 1), F.lit(1)
    word = (F.when(F.col("n_proxies") != needed, "DATA_UNAVAILABLE").when(F.col("rising") >= bull, "BULLISH").when(F.col("rising") <= bear, "BEARISH").otherwise("MIXED"))
    return x.join(state.withColumn("agreement", word), "group")


def horizon_decisions(x: DataFrame, crosses_weekend: Column, frozen: Column | bool = False) -> DataFrame:
    """Vetoes and status of the intraday and the three-session horizon for every proxy of ``agreement``.

    ``x`` carries ready (lanes that may be sized) and gap_atr (last opening gap in ranges).
    """
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    votes = yes(F.col("trend_vote")) + yes(F.col("momentum_vote")) + yes(F.col("agreement") == "BULLISH") + yes(F.col("dollar_vote"))
    x = x.withColumn("votes", votes).withColumn("horizon", F.explode(F.array(F.lit("INTRADAY"), F.lit("SWING_3D"))))
    vetoes = reasons(
        PROXY_BARS=(F.col("agreement") == "DATA_UNAVAILABLE") | ~F.coalesce("same_session", F.lit(False)),
        REFERENCES=F.col("ovx").isNull() | F.col("dollar").isNull(),
        NO_LANE=F.coalesce("ready", F.lit(0)) == 0,
        ENTRY_GAP=F.coalesce(F.col("gap_atr") > 1.5, F.lit(False)),
        VOLATILITY_HIGH=F.coalesce("volatile", F.lit(False)),
        PROXY_AGREEMENT=F.col("agreement") != "BULLISH",
        COMPOSITE_ABSENT=F.col("votes") < 3,
        CROSSES_WEEKEND=(F.col("horizon") == "SWING_3D") & F.coalesce(crosses_weekend, F.lit(False)),
    )
    held = frozen if isinstance(frozen, Column) else F.lit(frozen)
    status = F.when(F.size(vetoes) > 0, "NO_TRADE").when(held, "PAPER_LONG").otherwise("WATCH")
    return x.withColumn("vetoes", F.array_join(vetoes, ",")).withColumn("status", status)
