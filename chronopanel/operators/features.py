"""Price features as session-counted window expressions over the long panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import compounded, framed, over_sessions, shifted

ROOT_YEAR = 252.0**0.5
NOISE = 1e-12  # estimates below this are rounding noise around zero


def session_returns(p: DataFrame) -> DataFrame:
    """Close-to-close, overnight and intraday legs, simple and log."""
    prior = shifted("px", 1)
    return p.withColumn("prior", prior).select(
        "*",
        (F.col("px") / F.col("prior") - 1).alias("total_ret"),
        F.ln(F.col("px") / F.col("prior")).alias("total_log"),
        (F.col("open_adj") / F.col("prior") - 1).alias("overnight"),
        F.ln(F.col("open_adj") / F.col("prior")).alias("overnight_log"),
        (F.col("px") / F.col("open_adj") - 1).alias("intraday"),
        F.ln(F.col("px") / F.col("open_adj")).alias("intraday_log"),
    )


def momentum(lookback: int = 252, skip: int = 21) -> Column:
    return shifted("px", skip) / shifted("px", lookback) - 1


def reversal(lookback: int = 5) -> Column:
    return -(F.col("px") / shifted("px", lookback) - 1)


def log_return() -> Column:
    return F.ln(F.col("px") / shifted("px", 1))


def log_volatility(logret: str = "log_ret", window: int = 252) -> Column:
    return framed(F.stddev_samp(logret), logret, window) * F.lit(ROOT_YEAR)


def simple_volatility(ret: str = "ret", window: int = 21) -> Column:
    return framed(F.stddev_samp(ret), ret, window) * F.lit(ROOT_YEAR)


def high_proximity(window: int = 252) -> Column:
    return F.col("px") / framed(F.max("px"), "px", window)


def amihud(window: int = 21) -> Column:
    daily = F.abs(F.col("ret")) / F.nullif(F.col("px") * F.col("volume"), F.lit(0.0))
    return framed(F.avg(daily), daily, window)


def max_lottery(window: int = 21) -> Column:
    return framed(F.max("ret"), "ret", window)


def overnight_gap(window: int = 21) -> Column:
    gap = (F.col("open_adj") / F.col("px1") - 1) - (F.col("px") / F.col("open_adj") - 1)
    return framed(F.avg(gap), gap, window)


def volume_shock() -> Column:
    """Mean volume of 5 over mean of 60 sessions, both ending one session back."""
    return framed(F.avg("volume"), "volume", 5, end=-1) / framed(F.avg("volume"), "volume", 60, end=-1)


def trailing_dollar_volume(window: int = 20, fallback: float = 1e8) -> Column:
    """Mean dollar volume of the previous sessions; unknown liquidity becomes the fallback."""
    value = F.avg(F.col("px") * F.col("volume")).over(over_sessions(-window, -1))
    return F.coalesce(value, F.lit(fallback))


def canonical_features(p: DataFrame) -> DataFrame:
    """The four price signals that need nothing but adjusted closes; one window partitioning."""
    return p.withColumn("log_ret", log_return()).select(
        "*",
        momentum().alias("momentum"),
        reversal().alias("reversal"),
        (-log_volatility()).alias("low_volatility"),
        high_proximity().alias("high_proximity"),
    )


def market_return(r: DataFrame) -> DataFrame:
    """Equal-weight return per session; at most one row per session, so it is broadcast-sized by construction."""
    return r.groupBy("session", "pos").agg(F.avg("ret").alias("mkt"))


def leave_one_out(r: DataFrame, value: str = "ret", out: str = "peer") -> DataFrame:
    """Sector mean without the row itself; null for an ineligible row or a lone member."""
    w = W.partitionBy("session", "sector")
    rest = F.count(value).over(w) - 1
    return r.withColumn(
        out,
        F.when(F.col(value).isNotNull() & (rest > 0), (F.sum(value).over(w) - F.col(value)) / rest),
    )


def _lagged_cov(x: str, y: str, window: int, minimum: int) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))

    def mean(v):
        return framed(F.avg(v), v, window, end=-1, minimum=minimum)

    return mean(a * b) - mean(a) * mean(b)


def two_factor_betas(r: DataFrame, window: int = 252, minimum: int = 126) -> DataFrame:
    """Market and peer betas from sessions up to the previous one (two-by-two normal equations)."""
    single = market_return(r).withColumn("one", F.lit(1))
    frame = W.partitionBy("one").orderBy("pos").rangeBetween(-window, -1)
    m = F.col("mkt")
    market = single.select(
        "pos",
        "mkt",
        F.when(F.count(m).over(frame) >= minimum, F.avg(m * m).over(frame) - F.avg(m).over(frame) ** 2).alias("vm"),
    )
    x = leave_one_out(r).join(market, "pos", "left")
    x = x.select(
        "*",
        _lagged_cov("peer", "peer", window, minimum).alias("vs"),
        _lagged_cov("mkt", "peer", window, minimum).alias("cms"),
        _lagged_cov("ret", "mkt", window, minimum).alias("cam"),
        _lagged_cov("ret", "peer", window, minimum).alias("cas"),
    )
    det = F.col("vm") * F.col("vs") - F.col("cms") ** 2
    safe = F.when(F.abs(det) > 2.220446049250313e-16, det)
    return x.select(
        *[c for c in x.columns if c not in ("vm", "vs", "cms", "cam", "cas")],
        ((F.col("cam") * F.col("vs") - F.col("cas") * F.col("cms")) / safe).alias("beta_market"),
        ((F.col("cas") * F.col("vm") - F.col("cam") * F.col("cms")) / safe).alias("beta_sector"),
    )


def reversal_signals(r: DataFrame, lookback: int = 5, window: int = 252, minimum: int = 126, vol: int = 20) -> DataFrame:
    """Raw, sector-neutral and residual reversal; betas and residual volatility stop one session back."""
    b = two_factor_betas(r, window, minimum)
    one = W.partitionBy(F.lit(1)).orderBy("pos").rangeBetween(1 - lookback, 0)
    market = market_return(r).select(
        "pos", F.when(F.count("mkt").over(one) == lookback, F.product(F.col("mkt") + 1).over(one) - 1).alias("mkt_n")
    )
    b = b.join(market, "pos", "left").withColumn(
        "resid", F.col("ret") - F.col("beta_market") * F.col("mkt") - F.col("beta_sector") * F.col("peer")
    )
    b = b.select(
        "*",
        (F.col("px") / shifted("px", lookback) - 1).alias("own_n"),
        compounded("peer", lookback).alias("peer_n"),
        framed(F.stddev_samp("resid"), "resid", vol, end=-1).alias("resid_vol"),
    )
    scale = F.col("resid_vol") * F.lit(float(lookback) ** 0.5)
    left = F.col("own_n") - F.col("beta_market") * F.col("mkt_n") - F.col("beta_sector") * F.col("peer_n")
    return b.select(
        "*",
        (-F.col("own_n")).alias("raw"),
        (-(F.col("own_n") - F.col("peer_n"))).alias("sector_neutral"),
        (-left / F.when(F.abs(scale) > 1e-12, scale)).alias("residual"),
    )


def risk_ranking_features(r: DataFrame) -> DataFrame:
    """Trailing sd (252, 63) and beta to the equal-weight market, all lagged one session."""
    x = r.join(market_return(r).select("pos", "mkt"), "pos")
    cov = framed(F.covar_samp("ret", "mkt"), F.col("ret") * F.col("mkt"), 252, end=-1)
    var = framed(F.var_samp("mkt"), "mkt", 252, end=-1)
    return x.select(
        "*",
        framed(F.stddev_samp("ret"), "ret", 252, end=-1).alias("sd252"),
        framed(F.stddev_samp("ret"), "ret", 63, end=-1).alias("sd63"),
        (cov / F.nullif(var, F.lit(0.0))).alias("beta252"),
    )


def ma_regime(window: int = 200) -> Column:
    level = framed(F.avg("px"), "px", window)
    return F.when(level.isNull(), "UNKNOWN").when(F.col("px") > level, "UP").otherwise("DOWN")


def vol_index_regime(level: Column, calm: float = 15.0, stressed: float = 25.0) -> Column:
    return (
        F.when(level.isNull(), "UNKNOWN").when(level < calm, "LOW").when(level <= stressed, "NORMAL").otherwise("HIGH")
    )


def drawdown(streams: DataFrame, key: str = "trial", order: str = "pos", value: str = "ret") -> DataFrame:
    """Equity from 1, its running peak (start value included) and the fraction below it."""
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    e = streams.withColumn("equity", F.product(F.coalesce(F.col(value), F.lit(0.0)) + 1).over(so_far))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(so_far)))
    return e.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def true_range(high="high", low="low", prior: Column | None = None) -> Column:
    p = prior if prior is not None else F.col("prior_close")
    h, lo = F.col(high), F.col(low)
    return F.greatest(h - lo, F.coalesce(F.abs(h - p), h - lo), F.coalesce(F.abs(lo - p), h - lo))


def bollinger_b(window: int = 20, deviations: float = 2.0, key: str = "symbol") -> Column:
    """Position inside the bands; bands use the population sd of the symbol's own last rows."""
    w = W.partitionBy(key).orderBy("session").rowsBetween(1 - window, 0)
    mid, sd = F.avg("px").over(w), F.stddev_pop("px").over(w)
    width = F.lit(2.0 * deviations) * sd
    ok = (F.count("px").over(w) == window) & (width > 1e-9)
    return F.when(ok, (F.col("px") - (mid - F.lit(deviations) * sd)) / width)


def corwin_schultz() -> Column:
    """Two-day high-low spread; a non-positive estimate is unknown, not zero."""
    h, lo = F.col("high_adj"), F.col("low_adj")
    h1, l1 = shifted(h, 1), shifted(lo, 1)
    beta = F.ln(h / lo) ** 2 + F.ln(h1 / l1) ** 2
    gamma = F.ln(F.greatest(h, h1) / F.least(lo, l1)) ** 2
    k = 3.0 - 2.0 * 2.0**0.5
    alpha = (F.sqrt(F.lit(2.0) * beta) - F.sqrt(beta)) / F.lit(k) - F.sqrt(gamma / F.lit(k))
    s = F.lit(2.0) * (F.exp(alpha) - 1) / (F.lit(1.0) + F.exp(alpha))
    return F.when(s > NOISE, s)


def abdi_ranaldo() -> Column:
    mid = (F.ln("high_adj") + F.ln("low_adj")) / 2
    gap = F.ln("px") - mid
    sq = F.lit(4.0) * gap * (F.ln("px") - shifted(mid, -1))
    return F.when(sq > NOISE, F.sqrt(sq))
