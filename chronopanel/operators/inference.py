"""Mean tests and return summaries for many streams at once.

A stream has one row per session, so its values fit one array whatever the number of trials. Lag
products are folds over two shifted slices of that array: one shuffle by key, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.distributions import normal_cdf, normal_ppf, student_sf


def ordered_values(df: DataFrame, keys: list[str], order: str, value: str, out: str = "xs") -> DataFrame:
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))
    return x.groupBy(*keys).agg(
        F.transform(pairs, lambda s: s["v"]).alias(out), F.count(value).alias("n"), F.avg(value).alias("mean"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def auto_lag(n: Column, holding: Column | int = 1, requested: int | None = None) -> Column:
    h = holding if isinstance(holding, Column) else F.lit(holding)
    base = F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))) if requested is None else F.lit(requested)
    return F.least(n - 1, F.greatest(base, h - 1)).cast("int")


def bartlett_variance(centered: Column, n: Column, lags: Column) -> Column:
    """Long-run variance; every autocovariance is divided by n and the result floored at zero."""
    size = F.size(centered)

    def product(k):
        pairs = F.zip_with(F.slice(centered, k + 1, size - k), F.slice(centered, F.lit(1), size - k), lambda a, b: a * b)
        return total(pairs) / n

    zero = total(F.transform(centered, lambda v: v * v)) / n
    more = F.when(
        lags >= 1,
        F.aggregate(F.sequence(F.lit(1), lags), F.lit(0.0),
                    lambda acc, k: acc + F.lit(2.0) * (F.lit(1.0) - k / (lags + 1.0)) * product(k)),
    ).otherwise(0.0)
    return F.greatest(zero + more, F.lit(0.0))


def hac(df: DataFrame, keys: list[str], order: str, value: str, holding: int = 1, requested: int | None = None,
        null_mean: float = 0.0) -> DataFrame:
    """n, mean, HAC standard error, t and lag count per key; a zero error gives an infinite t."""
    x = ordered_values(df, keys, order, value).withColumn("lags", auto_lag(F.col("n"), holding, requested))
    x = x.withColumn("_c", F.transform("xs", lambda v: v - F.col("mean")))
    x = x.withColumn("se", F.when(F.col("n") >= 2, F.sqrt(bartlett_variance(F.col("_c"), F.col("n"), F.col("lags")) / F.col("n"))))
    d = F.col("mean") - F.lit(null_mean)
    t = F.when(F.col("se") > 0, d / F.col("se")).when(d > 0, float("inf")).when(d < 0, float("-inf")).when(F.col("se").isNotNull(), 0.0)
    return x.select(*keys, "n", "mean", "se", t.alias("t"), "lags")


def with_p(tests: DataFrame, alternative: str = "two-sided") -> DataFrame:
    """Student-t p-value with n - 1 degrees of freedom."""
    tail = student_sf(F.abs("t") if alternative == "two-sided" else F.col("t"), (F.col("n") - 1).cast("double"))
    p = {"two-sided": 2.0 * tail, "greater": tail, "less": 1.0 - tail}[alternative]
    return tests.withColumn("p", p)


def summarize(df: DataFrame, keys: list[str], value: str, minimum: int = 100, per_year: float = 252.0) -> DataFrame:
    """Count, mean, sd, annual Sharpe, hit rate, bias-corrected skewness and Pearson kurtosis.

    One aggregation with map-side combining. Spark's skewness and kurtosis are the plain moments; the
    corrections are closed forms in n.
    """
    v = F.col(value).cast("double")
    x = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.avg((v > 0).cast("double")).alias("hit_rate"), F.skewness(v).alias("_g1"), F.kurtosis(v).alias("_g2"))
    n = F.col("n").cast("double")
    skew = F.when(F.col("n") >= 3, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") >= 4, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3)
    return x.select(
        *keys, "n", "mean", "sd", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * F.lit(per_year**0.5)).alias("sharpe"),
        "hit_rate", skew.alias("skew"), kurt.alias("kurtosis"), (F.col("n") >= minimum).alias("enough"))


def sharpe_error(sharpe: Column, n: Column, skew: Column, kurt: Column) -> Column:
    term = F.lit(1.0) - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe
    return F.when((n >= 2) & (term > 0), F.sqrt(term / (n - 1.0)))


def probabilistic_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    se = sharpe_error(sharpe, n, skew, kurt)
    z = (sharpe - benchmark) / se
    flat = F.when(sharpe == benchmark, 0.5).otherwise((sharpe > benchmark).cast("double"))
    return F.when(se.isNull() | (se == 0), flat).otherwise(normal_cdf(z))


def expected_maximum(n_trials: Column, spread: Column) -> Column:
    """Expected best of n independent trials with null mean zero."""
    g = F.lit(0.5772156649015329)
    high = normal_ppf(F.lit(1.0) - F.lit(1.0) / n_trials)
    higher = normal_ppf(F.lit(1.0) - F.lit(1.0) / (n_trials * F.exp(F.lit(1.0))))
    return F.when((n_trials <= 1) | (spread == 0), 0.0).otherwise(spread * ((F.lit(1.0) - g) * high + g * higher))


def deflated(metrics: DataFrame, total_trials: int | None = None) -> DataFrame:
    """PSR and DSR of every trial. The dispersion of the unannualised Sharpes is one row per family,
    aggregated first and broadcast back (a scalar)."""
    m = metrics.withColumn("unit_sharpe", F.col("mean") / F.nullif("sd", F.lit(0.0)))
    family = m.agg(F.coalesce(F.stddev_samp("unit_sharpe"), F.lit(0.0)).alias("family_sd"), F.count("*").cast("double").alias("family_n"))
    m = m.join(F.broadcast(family))
    trials = F.lit(float(total_trials)) if total_trials else F.col("family_n")
    m = m.withColumn("hurdle", expected_maximum(trials, F.col("family_sd")))
    args = (F.col("n").cast("double"), F.col("skew"), F.col("kurtosis"))
    return m.withColumn("psr", probabilistic_sharpe(F.col("unit_sharpe"), F.lit(0.0), *args)).withColumn(
        "dsr", probabilistic_sharpe(F.col("unit_sharpe"), F.col("hurdle"), *args))


# ---- multiple testing -------------------------------------------------------------------------

BUCKETS = 1024


def benjamini_hochberg(df: DataFrame, p: str = "p", q: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """Adjusted p-values within a family, without one global sort.

    Equal p-values share an adjusted value, so they are counted first. Distinct values are spread over
    ordered buckets (log scale); ranks and the running minimum are swept inside a bucket and linked by a
    table of at most ``BUCKETS`` rows per family.
    """
    family = family or []
    bucket = F.when(F.col(p) >= 1, F.lit(BUCKETS)).otherwise(
        F.greatest(F.lit(0), F.lit(BUCKETS - 1) + F.floor(F.ln(F.greatest(F.col(p), F.lit(1e-300))) * 16).cast("int")))
    distinct = df.groupBy(*family, p).agg(F.count("*").alias("_c")).withColumn("_b", bucket)
    inside = W.partitionBy(*family, "_b").orderBy(p)
    size = distinct.groupBy(*family, "_b").agg(F.sum("_c").alias("_s"))
    across = W.partitionBy(*family).orderBy("_b")
    size = size.select(
        *family, "_b", (F.sum("_s").over(across) - F.col("_s")).alias("_before"), F.sum("_s").over(W.partitionBy(*family)).alias("_m"))
    x = distinct.join(size, [*family, "_b"]).withColumn("_rank", F.col("_before") + F.sum("_c").over(inside))
    x = x.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    later = x.groupBy(*family, "_b").agg(F.min("_raw").alias("_lo")).select(
        *family, "_b", F.min("_lo").over(across.rowsBetween(1, W.unboundedFollowing)).alias("_next"))
    x = x.join(later, [*family, "_b"]).select(
        *family, p, F.least(F.lit(1.0), F.coalesce("_next", F.lit(1.0)), F.min("_raw").over(inside.rowsBetween(0, W.unboundedFollowing))).alias("p_bh"))
    return df.join(x, [*family, p]).withColumn("reject_bh", F.col("p_bh") <= q)


def bonferroni(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    count = df.agg(F.count("*").alias("_m"))
    x = df.join(F.broadcast(count)).withColumn("p_bonf", F.least(F.lit(1.0), F.col(p) * F.col("_m"))).drop("_m")
    return x.withColumn("reject_bonf", F.col("p_bonf") <= alpha)


def gauntlet(metrics: DataFrame, minimum: int = 100, t_threshold: float = 3.0, q: float = 0.05, dsr_min: float = 0.95) -> DataFrame:
    """Hard gates; an ineligible trial stays in the family with p = 1."""
    ok = (F.col("n") >= minimum) & (F.col("mean") > 0) & F.col("p").isNotNull()
    x = metrics.withColumn("p_gate", F.when(ok, F.col("p")).otherwise(1.0))
    x = benjamini_hochberg(x, "p_gate", q)
    gates = {
        "gate_sample": F.col("n") >= minimum, "gate_sign": F.col("mean") > 0, "gate_t": F.col("t") > t_threshold,
        "gate_fdr": F.col("reject_bh"), "gate_dsr": F.col("dsr") > dsr_min,
    }
    for name, rule in gates.items():
        x = x.withColumn(name, F.coalesce(rule, F.lit(False)))
    survivor = F.lit(True)
    for name in gates:
        survivor = survivor & F.col(name)
    return x.withColumn("survivor", survivor)


def shrink(df: DataFrame, estimate: str, variance: str) -> DataFrame:
    """Empirical-Bayes shrinkage towards the grand mean (between variance floored at zero)."""
    family = df.agg(
        F.avg(estimate).alias("_g"),
        F.greatest(F.coalesce(F.var_samp(estimate), F.lit(0.0)) - F.avg(variance), F.lit(0.0)).alias("_tau"))
    x = df.join(F.broadcast(family))
    weight = F.when(F.col("_tau") + F.col(variance) > 0, F.col("_tau") / (F.col("_tau") + F.col(variance))).otherwise(1.0)
    return x.withColumn("reliability", weight).withColumn(
        "shrunk", F.col("_g") + F.col("reliability") * (F.col(estimate) - F.col("_g"))).drop("_g", "_tau")


def event_difference(df: DataFrame, keys: list[str], order: str, value: str, flag: str) -> DataFrame:
    """Event mean minus the rest, with a HAC error of the influence function."""
    v, f = F.col(value), F.col(flag)
    sides = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.avg(F.when(f, v)).alias("event_mean"), F.avg(F.when(~f, v)).alias("rest_mean"),
        F.avg(f.cast("double")).alias("_s"), F.count_if(f).alias("n_event"))
    x = df.where(v.isNotNull()).join(sides, keys)
    infl = F.when(f, (v - F.col("event_mean")) / F.col("_s")).otherwise(-(v - F.col("rest_mean")) / (F.lit(1.0) - F.col("_s")))
    tests = hac(x.withColumn("_i", infl), keys, order, "_i")
    return sides.join(tests.select(*keys, "n", "se"), keys).withColumn(
        "difference", F.col("event_mean") - F.col("rest_mean")).withColumn("t", F.col("difference") / F.nullif("se", F.lit(0.0)))


def regime_interaction(df: DataFrame, keys: list[str], order: str, value: str, flag: str, holding: int = 1) -> DataFrame:
    """OLS of a return on a binary regime with a HAC covariance: slope, error and t.

    The slope's influence is (d - mean d) x residual, so its variance is one Bartlett sum.
    """
    v, d = F.col(value), F.col(flag).cast("double")
    x = df.where(v.isNotNull() & F.col(flag).isNotNull())
    fit = x.groupBy(*keys).agg(
        F.avg(d).alias("_d"), F.avg(v).alias("_y"), F.covar_pop(d, v).alias("_c"), F.var_pop(d).alias("_v"), F.count(v).alias("n"),
        F.avg(F.when(F.col(flag), v)).alias("mean_on"), F.avg(F.when(~F.col(flag), v)).alias("mean_off"))
    fit = fit.withColumn("slope", F.col("_c") / F.nullif("_v", F.lit(0.0)))
    score = (d - F.col("_d")) * (v - F.col("_y") - F.col("slope") * (d - F.col("_d")))
    pieces = ordered_values(x.join(fit.drop("n"), keys).withColumn("_s", score), keys, order, "_s", "ss").withColumnRenamed("n", "_n").drop("mean")
    fit = fit.join(pieces, keys).withColumn("lags", auto_lag(F.col("n"), holding))
    lrv = bartlett_variance(F.col("ss"), F.col("n"), F.col("lags"))
    return fit.withColumn("se", F.sqrt(lrv / F.col("n")) / F.col("_v")).select(
        *keys, "n", "mean_on", "mean_off", "slope", "se", (F.col("slope") / F.nullif("se", F.lit(0.0))).alias("t"))
