"""Look-ahead checks and independent second formulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from .inference import hac


def shift_collapse(grid: DataFrame, base: int = 1, t_min: float = 3.0, noise: float = 1.96) -> DataFrame:
    """A signal built from the next return must be strong at the base lag and vanish one session later."""
    w = W.partitionBy("symbol").orderBy("pos")
    zero = F.lit(0.0)
    x = grid.select("symbol", "pos", "ret", F.coalesce(F.signum(F.lead("ret").over(w)), zero).alias("s"))
    r = F.coalesce("ret", zero)
    legs = [F.struct(F.lit(name).alias("leg"), (F.coalesce(F.lag("s", k).over(w), zero) * r).alias("v")) for name, k in (("base", base), ("shifted", base + 1))]
    t = hac(x.select("symbol", "pos", F.array(*legs).alias("l")).select("symbol", "pos", F.inline("l")), ["symbol", "leg"], "pos", "v")
    y = t.groupBy("symbol").agg(F.max(F.when(F.col("leg") == "base", F.col("t"))).alias("t_base"), F.max(F.when(F.col("leg") == "shifted", F.col("t"))).alias("t_shifted"))
    return y.withColumn("collapses", (F.col("t_base") > t_min) & (F.abs("t_shifted") < noise))


def availability_report(bars: DataFrame) -> DataFrame:
    """Per way of filling: bars not available before the symbol's next open, and fills not later than their signal.

    A signal exists from `available_at`; SAME_CLOSE fills at the close of its session, NEXT_OPEN at the symbol's next open.
    """
    w = W.partitionBy("symbol").orderBy("session")
    nxt = F.lead(clock.new_york_instant("session", 9, 30)).over(w)
    x = bars.select("available_at", clock.market_close("session").alias("own_close"), nxt.alias("next_open"))
    legs = F.array(*[F.struct(F.lit(n).alias("leg"), F.col(c).alias("fill_at")) for n, c in (("SAME_CLOSE", "own_close"), ("NEXT_OPEN", "next_open"))])
    x = x.select("available_at", "next_open", F.inline(legs))
    return x.groupBy("leg").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("available_at") >= F.col("next_open")).alias("late"), F.count_if(F.col("fill_at") <= F.col("available_at")).alias("early_fills"))


def recompute_gross(entries: DataFrame, market: DataFrame, streams: DataFrame, holding: int, lag: int) -> DataFrame:
    """Total gross per trial from trades instead of positions: each entry collects its own held returns."""
    trade = entries.select("trial", "symbol", F.col("weight").alias("w"), F.explode(F.sequence(F.col("pos") + lag, F.col("pos") + lag + holding - 1)).alias("pos"))
    earned = trade.join(market.where("ret is not null").select("symbol", "pos", "ret"), ["symbol", "pos"]).groupBy("trial").agg(
        (F.sum(F.col("w") * F.col("ret")) / holding).alias("fold_total"))
    total = streams.groupBy("trial").agg(F.sum("gross").alias("stream_total"))
    x = total.join(earned, "trial", "left")
    return x.withColumn("agrees", F.abs(F.col("fold_total") - F.col("stream_total")) < 1e-6)


def survivor_causality(build, evaluate, panel: DataFrame, sessions: int, holding: int, lag: int, margin: float = 1.0) -> DataFrame:
    """Each trial's plan run again on a shorter past and with a later fill, as rows of one job.

    ``build(panel, lag)`` gives positions (trial, symbol, pos, weight) and ``evaluate(positions)`` streams with `net`.
    The last sessions are cut off; positions below a buffer before the cut must be the same in both directions (a row
    that appears counts as one that disappears). A fill one session later may not raise the t by more than the margin.
    """
    buffer = max(25, holding + lag + 5)
    length = sessions - buffer
    full = build(panel, lag)
    t = lambda x, name: hac(evaluate(x), ["trial"], "pos", "net", holding).select("trial", F.col("t").alias(name))
    tests = t(full, "baseline_t").join(t(build(panel, lag + 1), "extra_lag_t"), "trial", "left")
    if length < 2 * buffer:
        counts = tests.select("trial", F.lit(0).cast("bigint").alias("n_compared"), F.lit(0).cast("bigint").alias("n_changed"))
    else:
        below = lambda x, name: x.where(F.col("pos") <= length - buffer).select("trial", "symbol", "pos", F.col("weight").alias(name))
        both = below(full, "a").join(below(build(panel.where(F.col("pos") <= length), lag), "b"), ["trial", "symbol", "pos"], "full")
        same = F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-12, F.lit(False))
        counts = both.groupBy("trial").agg(F.count("a").alias("n_compared"), F.count_if(~same).alias("n_changed"))
    x = tests.join(counts, "trial", "left").fillna(0, ["n_compared", "n_changed"])
    inflated = F.coalesce(F.col("extra_lag_t") > F.col("baseline_t") + margin, F.lit(False))
    x = x.withColumn("lag_inflation", inflated & F.lit(length >= 2 * buffer))
    reason = F.when(F.lit(length < 2 * buffer), "SAMPLE_TOO_SHORT").when(F.col("n_changed") > 0, "CHANGED_WITHOUT_THE_FUTURE").when(F.col("lag_inflation"), "STRONGER_WITH_EXTRA_LAG").otherwise("PASSED")
    return x.withColumn("reason", reason).withColumn("causal", F.col("reason").isin("SAMPLE_TOO_SHORT", "PASSED"))


def scalar_stream(signals: DataFrame, returns: DataFrame, rate: float) -> DataFrame:
    """(trial, pos, position, change, net): yesterday's signal held today, with a cost for each unit of change."""
    w = W.partitionBy("trial").orderBy("pos")
    x = signals.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0.0)))
    x = x.withColumn("change", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    x = x.join(returns, "pos")
    return x.select("trial", "pos", "position", "change", (F.col("position") * F.col("ret") - F.col("change") * rate).alias("net"))


def trade_segments(signals: DataFrame) -> DataFrame:
    """(trial, signal, first, last, change): runs of one signal on consecutive rows; change is the step to it."""
    w = W.partitionBy("trial").orderBy("pos")
    x = signals.withColumn("_new", F.coalesce(F.col("signal") != F.lag("signal").over(w), F.lit(True)).cast("int"))
    x = x.withColumn("_run", F.sum("_new").over(w))
    runs = x.groupBy("trial", "_run").agg(F.first("signal").alias("signal"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    before = F.coalesce(F.lag("signal").over(W.partitionBy("trial").orderBy("_run")), F.lit(0.0))
    return runs.select("trial", "signal", "first", "last", F.abs(F.col("signal") - before).alias("change"))


def confirm_scalars(signals: DataFrame, returns: DataFrame, rate: float, tolerance_bps: float = 1.0) -> DataFrame:
    """Trade counts and net means of scalar strategies from their daily rows and, again, from their trades.

    The second formulation knows no daily position: a trade is a run of one signal, entered one session after the run
    starts and left one session after it ends; what it earns is the difference of two running sums of returns. Signals
    stand on every session of `returns` (pos without gaps). Both must agree in count and, per trade, in the mean.
    """
    end = signals.agg(F.max("pos").alias("_end"))
    level = returns.select("pos", F.sum(F.coalesce("ret", F.lit(0.0))).over(W.orderBy("pos")).alias("level"))
    trades = trade_segments(signals).join(F.broadcast(end)).where(F.col("change") + F.abs("signal") > 0)
    trades = trades.withColumn("leave", F.least(F.col("last") + 1, F.col("_end"))).where(F.col("first") < F.col("_end"))
    at = lambda c, name: level.select(F.col("pos").alias(c), F.col("level").alias(name))
    trades = trades.join(at("first", "_a"), "first").join(at("leave", "_b"), "leave")
    own = trades.groupBy("trial").agg(
        F.count_if(F.col("change") > 0).alias("trades"), F.sum(F.col("signal") * (F.col("_b") - F.col("_a")) - F.col("change") * rate).alias("total"))
    daily = scalar_stream(signals, returns, rate).groupBy("trial").agg(
        F.count_if(F.col("change") > 0).alias("vector_trades"), F.avg("net").alias("vector_mean"), F.count("net").alias("n"))
    x = daily.join(own, "trial", "left").fillna(0, ["trades", "total"]).withColumn("net_mean", F.col("total") / F.col("n"))
    gap = F.abs(F.col("net_mean") - F.col("vector_mean")) * 1e4 * F.col("n") / F.greatest("trades", F.lit(1))
    x = x.withColumn("bps_per_trade", gap).withColumn("count_match", F.col("trades") == F.col("vector_trades"))
    return x.withColumn("passed", F.col("count_match") & (F.col("bps_per_trade") <= tolerance_bps))


def plateaus(x: DataFrame, within: float = 0.2) -> DataFrame:
    """A setting counts only when an adjacent setting is also within reach of the family's best."""
    g, w = W.partitionBy("family"), W.partitionBy("family").orderBy("parameter")
    y = x.withColumn("ok", (F.col("score") > 0) & (F.col("score") >= F.lit(1.0 - within) * F.max("score").over(g)))
    no = F.lit(False)
    return y.withColumn("plateau", F.col("ok") & (F.coalesce(F.lead("ok").over(w), no) | F.coalesce(F.lag("ok").over(w), no)))
