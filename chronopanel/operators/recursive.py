"""Recursions that are not frames: exponential averages and running winsorisation, as JVM folds over a symbol's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import true_range
from .folds import fold

#: Averages by name: their input and their weight for a new value.
AVERAGES = {
    "ema": ("px", 2.0 / 21), "atr": ("tr", 1.0 / 14),
    "gain14": ("gain", 1.0 / 14), "loss14": ("loss", 1.0 / 14), "gain2": ("gain", 0.5), "loss2": ("loss", 0.5),
}


def indicators(p: DataFrame) -> DataFrame:
    """EMA(20), relative strength over 14 and 2 rows, true range and its average, with and without warm-up.

    What needs only neighbours comes from frames; the fold carries nothing but the six averages and a row count.
    """
    own = W.partitionBy("symbol").orderBy("session")
    x = p.select("symbol", "session", "px", "high_adj", "low_adj").withColumn("prior_close", F.lag("px").over(own))
    change = F.col("px") - F.col("prior_close")
    x = x.select("symbol", "session", "px", true_range("high_adj", "low_adj").alias("tr"), F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))).alias("gain"), F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))).alias("loss"))
    none = F.lit(None).cast("double")

    def step(state, row):
        blend = {n: F.coalesce(state[n] * (1 - a) + row[c] * a, row[c], state[n]) for n, (c, a) in AVERAGES.items()}
        return {"rows": state["rows"] + 1, **blend}

    def strength(s, n):
        gain, loss, seen = s[f"gain{n}"], s[f"loss{n}"], s["rows"]
        even = F.when(gain > 0, 100.0).otherwise(50.0)
        return F.when(seen > n, F.when(loss == 0, even).otherwise(100.0 - 100.0 / (1.0 + gain / loss)))

    def emit(_, s, row):
        return {
            "ema20": F.when(s["rows"] >= 20, s["ema"]), "rsi14": strength(s, 14), "rsi2": strength(s, 2),
            "tr": row["tr"], "atr14": F.when(s["rows"] >= 14, s["atr"]), "atr14_early": s["atr"],
        }

    start = {"rows": F.lit(0), **{n: none for n in AVERAGES}}
    types = "ema20:double,rsi14:double,rsi2:double,tr:double,atr14:double,atr14_early:double"
    return fold(x, ["symbol"], "session", ["px", "tr", "gain", "loss"], start, step, emit, types)


def causal_winsorize(p: DataFrame, sigma: float = 10.0, minimum: int = 20) -> DataFrame:
    """Clip each log return (taken against the corrected path) to the accepted history's mean +- sigma sd and rebuild
    the price path. The state is the corrected log level with the number, sum and squared sum of accepted moves."""
    none, nought = F.lit(None).cast("double"), F.lit(0.0)

    def step(s, row):
        level = F.ln(row["px"])
        spread = s["squares"] - s["total"] * s["total"] / s["n"]
        mean, reach = s["total"] / s["n"], sigma * F.sqrt(spread / (s["n"] - 1))
        bound = (s["n"] >= minimum) & (spread > 1e-18)
        raw = level - s["path"]
        move = F.when(bound, F.greatest(mean - reach, F.least(mean + reach, raw))).otherwise(raw)
        begun = s["path"].isNotNull()
        return {
            "path": F.when(begun, s["path"] + move).otherwise(level), "n": s["n"] + F.when(begun, 1.0).otherwise(0.0),
            "total": s["total"] + F.when(begun, move).otherwise(0.0), "squares": s["squares"] + F.when(begun, move * move).otherwise(0.0),
        }

    def emit(_, s, row):
        return {"px": row["px"], "fixed": F.exp(s["path"]), "corrected": F.abs(s["path"] - F.ln(row["px"])) > 1e-9}

    start = {"path": none, "n": nought, "total": nought, "squares": nought}
    return fold(p.select("symbol", "session", F.col("px").cast("double").alias("px")), ["symbol"], "session", ["px"], start, step, emit, "px:double,fixed:double,corrected:boolean")
