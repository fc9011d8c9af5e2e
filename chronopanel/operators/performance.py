"""Performance and path summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.costs import daily_cost
from .advisor import latest
from .features import drawdown
from .frames import over_sessions, shifted
from .selection import exact_quantiles


def performance(x: DataFrame, value: str, bench: str, per_year: float = 252.0) -> DataFrame:
    """Growth, risk and benchmark-relative measures per trial; drawdown from the running peak."""
    dd = drawdown(x, "trial", "pos", value).groupBy("trial").agg(F.min("drawdown").alias("max_drawdown"))
    r, b = F.col(value), F.col(bench)
    root = F.lit(per_year**0.5)
    logs = F.sum(F.log1p(r))
    beta = F.covar_samp(r, b) / F.var_samp(b)
    s = x.groupBy("trial").agg(
        (F.exp(logs) - 1).alias("total"), (F.exp(logs * per_year / F.count(r)) - 1).alias("cagr"), (F.stddev_samp(r) * root).alias("vol"),
        (F.avg(r) * root / F.nullif(F.sqrt(F.avg(F.least(r, F.lit(0.0)) ** 2)), F.lit(0.0))).alias("sortino"), beta.alias("beta"),
        ((F.avg(r) - beta * F.avg(b)) * per_year).alias("alpha"), (F.avg(r - b) / F.stddev_samp(r - b) * root).alias("info"),
        F.when(F.stddev_samp(r) > 0, F.corr(r, b)).alias("corr"))
    return s.join(dd, "trial")


# Era boundaries.
ERAS = (("EARLY", "1995-01-01", "1997-01-01"), ("MIDDLE", "1997-01-01", "1999-07-01"), ("LATE", "1999-07-01", "2002-01-01"))


def eras(r: DataFrame, bounds=ERAS) -> DataFrame:
    day = dt.date.fromisoformat
    era = None
    for name, a, b in bounds:
        hit = (F.col("session") >= F.lit(day(a))) & (F.col("session") < F.lit(day(b)))
        era = F.when(hit, name) if era is None else era.when(hit, name)
    return r.where("ret is not null").withColumn("era", era).where("era is not null").groupBy("symbol", "era").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"))


def magnitude_table(r: DataFrame, value: str) -> DataFrame:
    """101 empirical quantiles of up and of down magnitudes."""
    x = r.where(F.col(value) != 0).select(F.when(F.col(value) > 0, "UP").otherwise("DOWN").alias("direction"), F.abs(value).alias("magnitude"))
    q = exact_quantiles(x, ["direction"], "magnitude", [i / 100.0 for i in range(101)])
    return q.select("direction", F.round(F.col("p") * 100).cast("int").alias("percent"), F.col("quantile").alias("magnitude"))


def healing_peers(p: DataFrame) -> DataFrame:
    own = W.partitionBy("symbol").orderBy("session")
    f = own.rowsBetween(-19, 0)
    x = p.select("symbol", "sector", "session", "px", (F.col("px") / F.lag("px", 5).over(own) - 1).alias("r5"), F.when(F.count("px").over(f) == 20, F.avg("px").over(f)).alias("m20"))
    return latest(x).groupBy("sector").agg(F.count("*").alias("peers"), F.count_if((F.col("r5") > 0) & (F.col("px") > F.col("m20"))).alias("healing"))


def sensitivity(streams: DataFrame, positions: DataFrame, market: DataFrame, cal: DataFrame, multipliers=(0.5, 1.0, 2.0, 4.0), scales=(1.0, 10.0, 100.0, 1000.0)) -> DataFrame:
    """Mean net per cost multiplier and per capital scale; every scale is one more sum in the same pass."""
    base = streams.groupBy("trial").agg(F.avg("gross").alias("g"), F.avg("cost").alias("c"), F.count("*").alias("days"))
    x = positions.join(cal.select("pos"), "pos", "left_semi").join(market.select("symbol", "pos", "adv20"), ["symbol", "pos"], "left").join(
        market.select("symbol", "asset_type").distinct(), "symbol")
    args = (F.col("weight"), F.col("previous"), F.coalesce("adv20", F.lit(1e8)), F.col("asset_type"))
    caps = x.groupBy("trial").agg(*[F.sum(daily_cost(*args, scale=s)).alias(f"s{i}") for i, s in enumerate(scales)])
    y = base.join(caps, "trial")
    rows = F.array(
        *[F.struct(F.lit("COST").alias("kind"), F.lit(m).alias("factor"), (F.col("g") - F.col("c") * m).alias("net")) for m in multipliers],
        *[F.struct(F.lit("CAPACITY").alias("kind"), F.lit(s).alias("factor"), (F.col("g") - F.col(f"s{i}") / F.col("days")).alias("net")) for i, s in enumerate(scales)])
    return y.select("trial", F.inline(rows))


def leverage_study(r: DataFrame, leverage: float = 2.0, horizon: int = 5) -> DataFrame:
    """Worst excursion after entry at the next close, liquidations and levered outcome by entry state."""
    low = F.min("low_adj").over(over_sessions(2, horizon + 1))
    x = r.select("symbol", "ret", F.when(F.col("ret") < 0, "DOWN").otherwise("UP").alias("state"), shifted("px", -1).alias("en"), shifted("px", -horizon - 1).alias("ex"), low.alias("low"))
    x = x.where("ret is not null and en is not null and ex is not null").withColumn("exc", F.lit(1.0) - F.col("low") / F.col("en"))
    dead = F.col("exc") >= 1.0 / leverage
    out = F.when(dead, -1.0).otherwise(F.lit(leverage) * (F.col("ex") / F.col("en") - 1))
    return x.groupBy("symbol", "state").agg(
        F.count("*").alias("n"), F.avg(dead.cast("double")).alias("liquidated"), F.percentile(out, F.lit(0.5)).alias("median_levered"), F.percentile("exc", F.lit(0.95)).alias("p95_excursion"))


def year_context(p: DataFrame) -> DataFrame:
    own = W.partitionBy("symbol").orderBy("session")
    f = own.rowsBetween(-19, 0)
    x = p.withColumn("r", F.col("px") / F.lag("px").over(own) - 1)
    x = x.select("symbol", "session", "px", F.round(F.when(F.count("r").over(f) == 20, F.stddev_samp("r").over(f)), 9).alias("v"))
    now = x.groupBy("symbol").agg(F.max_by("px", "session").alias("last_px"), F.max_by("v", "session").alias("now_v"), F.max(F.year("session")).alias("y"))
    return x.join(now, "symbol").groupBy("symbol", "last_px").agg(
        F.max_by(F.when(F.year("session") < F.col("y"), F.col("px")), F.when(F.year("session") < F.col("y"), F.col("session"))).alias("base"),
        F.avg(F.when(F.col("v").isNotNull(), (F.col("v") <= F.col("now_v")).cast("double"))).alias("vol_percentile")).select(
        "symbol", (F.col("last_px") / F.col("base") - 1).alias("ytd"), "vol_percentile")
