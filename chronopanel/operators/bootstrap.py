"""Stationary and moving-block bootstrap as tables, and family tests on top of them.

Draws come from counter-based numbers, so every executor and every retry sees the same paths. A path
only enters the statistics through how often it visits each date, so one (rep, date) count table is
shared by all trials, and resampled means are a matrix product of counts and returns. The product runs
in blocks of reps and trials: an Arrow group holds (reps-in-block x dates) and (dates x trials-in-block)
and emits per-rep maxima or per-trial exceedances, never the full rep x trial matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import draw_index, uniform


def stationary_paths(spark: SparkSession, n: int, reps: int, block: float = 10.0, seed: int = 42) -> DataFrame:
    """(rep, pos, idx): restart with probability 1/block at a fresh date, else step on, wrapping around."""
    pos = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos")
    x = spark.range(reps, numPartitions=max(1, min(reps, 64))).select(F.col("id").alias("rep"), pos)
    restart = (F.col("pos") == 0) | (uniform(seed, "r", F.col("rep"), F.col("pos")) < 1.0 / block)
    fresh = draw_index(F.lit(n), seed, "f", F.col("rep"), F.col("pos"))
    x = x.withColumn("_at", F.when(restart, F.struct(F.col("pos").alias("p"), fresh.alias("f"))))
    w = W.partitionBy("rep").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_l", F.last("_at", True).over(w))
    return x.select("rep", "pos", ((F.col("_l.f") + F.col("pos") - F.col("_l.p")) % n).alias("idx"))


def moving_block_paths(spark: SparkSession, n: int, reps: int, block: int = 10, seed: int = 42) -> DataFrame:
    """(rep, pos, idx) from circular blocks of fixed length."""
    pos = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos")
    x = spark.range(reps, numPartitions=max(1, min(reps, 64))).select(F.col("id").alias("rep"), pos)
    b = F.floor(F.col("pos") / block).cast("bigint")
    start = draw_index(F.lit(n), seed, "b", F.col("rep"), b)
    return x.select("rep", "pos", ((start + F.col("pos") % block) % n).alias("idx"))


def date_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("rep", "idx").agg(F.count("*").alias("c"))


def indexed(streams: DataFrame, value: str) -> DataFrame:
    """(trial, idx, v): zero-based row number of each stream."""
    w = W.partitionBy("trial").orderBy("pos")
    return streams.select("trial", (F.row_number().over(w) - 1).alias("idx"), F.col(value).alias("v"))


def resampled_means(counts: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """(rep, trial, mean) by join; for moderate families and for checking the blocked form."""
    return counts.join(values, "idx").groupBy("rep", "trial").agg((F.sum(F.col("c") * F.col("v")) / n).alias("mean"))


def percentile_intervals(counts: DataFrame, values: DataFrame, n: int, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals of the mean and the annual Sharpe of every trial."""
    x = counts.join(values, "idx").groupBy("rep", "trial").agg(
        F.sum(F.col("c") * F.col("v")).alias("s1"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("s2"))
    return intervals_of_sums(x, n, confidence)


def blocked_sums(counts: DataFrame, values: DataFrame, n: int, rep_block: int = 512, trial_blocks: int = 1) -> DataFrame:
    """(rep, trial, s1, s2): sums and squared sums of each resample, as products in (rep block, trial block) groups."""
    tb = F.pmod(F.xxhash64("trial"), F.lit(trial_blocks)).cast("int")
    rb = F.floor(F.col("rep") / rep_block).cast("int")
    c = counts.withColumn("rb", rb).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(trial_blocks - 1))))
    top = counts.agg(F.max(rb).alias("top"))
    v = values.withColumn("tb", tb).join(F.broadcast(top)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "trial": [], "s1": [], "s2": []})
        reps, row = np.unique(left["rep"].to_numpy(), return_inverse=True)
        weight = np.zeros((len(reps), n))
        weight[row, left["idx"].to_numpy()] = left["c"].to_numpy()
        names, col = np.unique(right["trial"].to_numpy().astype(str), return_inverse=True)
        matrix = np.zeros((n, len(names)))
        matrix[right["idx"].to_numpy(), col] = right["v"].to_numpy()
        return pd.DataFrame({"rep": np.repeat(reps, len(names)), "trial": np.tile(names, len(reps)),
                             "s1": (weight @ matrix).ravel(), "s2": (weight @ (matrix * matrix)).ravel()})

    return c.groupBy("rb", "tb").cogroup(v.groupBy("rb", "tb")).applyInPandas(run, "rep bigint, trial string, s1 double, s2 double")


def intervals_of_sums(x: DataFrame, n: int, confidence: float = 0.95) -> DataFrame:
    """Percentile intervals from the (rep, trial, s1, s2) of all resamples."""
    mean = F.col("s1") / n
    var = (F.col("s2") - F.lit(float(n)) * mean * mean) / (n - 1.0)
    x = x.select("trial", mean.alias("m"), F.when(var > 1e-18, mean / F.sqrt(var) * F.lit(252.0**0.5)).alias("sh"))
    a = (1.0 - confidence) / 2.0
    q = lambda c, p: F.percentile(c, F.lit(p))
    return x.groupBy("trial").agg(
        F.count("*").alias("n_reps"), q("m", a).alias("mean_low"), q("m", 1 - a).alias("mean_high"),
        q("sh", a).alias("sharpe_low"), q("sh", 1 - a).alias("sharpe_high"))


def kernel_variance(values: DataFrame, n: int, block: float = 10.0) -> DataFrame:
    """Stationary-bootstrap long-run variance of each stream over all lags (array folds in the JVM)."""
    x = values.groupBy("trial").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda s: s["v"]).alias("xs"), F.avg("v").alias("mean"))
    return x.select("trial", "mean", _kernel(n, block)("xs", "mean").alias("lrv"))


def _kernel(n: int, block: float):
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def run(xs: pd.Series, mean: pd.Series) -> pd.Series:
        k = np.arange(1, n, dtype=float)
        keep = 1.0 - 1.0 / block
        weight = (1.0 - k / n) * keep**k + (k / n) * keep ** (n - k)
        size = 1 << (2 * n - 1).bit_length()
        out = []
        for x, m in zip(xs, mean, strict=True):
            f = np.fft.rfft(np.asarray(x, float) - m, size)
            cov = np.fft.irfft(f * f.conj(), size)[:n]
            out.append((cov[0] + 2.0 * float(weight @ cov[1:])) / n)
        return pd.Series(out)

    return run


def family_inputs(values: DataFrame, n: int, block: float = 10.0) -> DataFrame:
    """Mean, standard error, relevance-based centre and observed t of each trial."""
    m = kernel_variance(values, n, block)
    floor = -F.sqrt(F.greatest("lrv", F.lit(0.0)) / n * F.lit(2.0) * F.ln(F.greatest(F.ln(F.lit(float(n))), F.lit(1.0))))
    se = F.sqrt(F.greatest("lrv", F.lit(0.0)) / n)
    t = F.when(se > 0, F.col("mean") / se).when(F.col("mean") > 0, float("inf")).when(F.col("mean") < 0, float("-inf")).otherwise(0.0)
    return m.select("trial", "mean", se.alias("se"), F.when(F.col("mean") >= floor, F.col("mean")).otherwise(0.0).alias("center"), t.alias("t"))


def blocked_maxima(counts: DataFrame, values: DataFrame, family: DataFrame, n: int, rep_block: int = 512,
                   trial_block: int = 256, trial_blocks: int = 1) -> DataFrame:
    """Per (rep, trial block): largest mean recentred by the SPA centre and by the sample mean.

    Counts and returns are routed to (rep block, trial block) groups and multiplied there.
    """
    tb = F.pmod(F.xxhash64("trial"), F.lit(trial_blocks)).cast("int")
    rb = F.floor(F.col("rep") / rep_block).cast("int")
    c = counts.withColumn("rb", rb).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(trial_blocks - 1))))
    rep_blocks = counts.agg(F.max(rb).alias("top"))
    v = values.join(family.select("trial", "mean", "center"), "trial").withColumn("tb", tb)
    v = v.join(F.broadcast(rep_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "spa": [], "reality": []})
        reps, row = np.unique(left["rep"].to_numpy(), return_inverse=True)
        weight = np.zeros((len(reps), n))
        weight[row, left["idx"].to_numpy()] = left["c"].to_numpy()
        names, col = np.unique(right["trial"].to_numpy().astype(str), return_inverse=True)
        matrix, means, centers = np.zeros((n, len(names))), np.zeros(len(names)), np.zeros(len(names))
        matrix[right["idx"].to_numpy(), col] = right["v"].to_numpy()
        means[col], centers[col] = right["mean"].to_numpy(), right["center"].to_numpy()
        sampled = weight @ matrix / n
        return pd.DataFrame({"rep": reps, "spa": (sampled - centers).max(axis=1), "reality": (sampled - means).max(axis=1)})

    return c.groupBy("rb", "tb").cogroup(v.groupBy("rb", "tb")).applyInPandas(run, "rep bigint, spa double, reality double")


def family_p_values(maxima: DataFrame, family: DataFrame) -> DataFrame:
    """Superior-predictive-ability and reality-check p: share of reps strictly above the best mean."""
    best = family.agg(F.max("mean").alias("best"), F.max_by("trial", "mean").alias("best_trial"))
    x = maxima.groupBy("rep").agg(F.max("spa").alias("spa"), F.max("reality").alias("reality")).join(F.broadcast(best))
    return x.groupBy("best_trial", "best").agg(
        F.avg((F.col("spa") > F.col("best")).cast("double")).alias("spa_p"),
        F.avg((F.col("reality") > F.col("best")).cast("double")).alias("reality_p"), F.count("*").alias("n_reps"))


def romano_wolf(means: DataFrame, family: DataFrame, reps: int) -> DataFrame:
    """Stepdown max-t p-values: (1 + exceedances) / (reps + 1), monotone in the observed order.

    The maximum over the remaining trials is a running maximum inside one rep (its rows are the trials).
    """
    ranked = family.withColumn("k", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("t").desc(), "trial")))
    x = means.withColumnRenamed("mean", "m").join(ranked, "trial").withColumn(
        "bt", F.when(F.col("se") > 0, (F.col("m") - F.col("mean")) / F.col("se")).otherwise(0.0))
    w = W.partitionBy("rep").orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("rest", F.max("bt").over(w))
    p = x.groupBy("trial", "k", "t").agg(((F.count_if(F.col("rest") >= F.col("t")) + 1.0) / (reps + 1.0)).alias("raw"))
    up = W.partitionBy(F.lit(1)).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return p.select("trial", "t", "raw", F.least(F.lit(1.0), F.max("raw").over(up)).alias("p_rw"))


def blocked_stepdown(counts: DataFrame, values: DataFrame, family: DataFrame, n: int, reps: int, rep_block: int = 512, trial_block: int = 256) -> DataFrame:
    """Romano-Wolf p-values without a row for each rep and trial.

    Trials stand in the order of their t and are cut into blocks. A first product emits the largest centred t of each
    rep in a block; what the blocks behind a block reach is carried to it, and a second product counts, for each trial,
    the reps whose maximum over this trial and all behind it is at least its t.
    """
    k = F.row_number().over(W.orderBy(F.col("t").desc(), "trial")) - 1  # one row for each trial
    ranked = family.select("trial", "t", "mean", "se", k.alias("k")).withColumn("tb", F.floor(F.col("k") / trial_block).cast("int"))
    top = ranked.agg(F.max("tb").alias("top_tb")).join(counts.agg(F.max(F.floor(F.col("rep") / rep_block)).cast("int").alias("top_rb")))
    c = counts.join(F.broadcast(top)).select("rep", "idx", F.col("c").cast("double").alias("c"), F.floor(F.col("rep") / rep_block).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("top_tb"))).alias("tb"))
    v = values.join(ranked, "trial").join(F.broadcast(top)).select("trial", "idx", "v", "t", "mean", "se", "k", "tb", F.explode(F.sequence(F.lit(0), F.col("top_rb"))).alias("rb"))

    def centred(left: pd.DataFrame, right: pd.DataFrame):
        """(reps, their carried maxima, ranks and t of the trials, centred t of each rep and trial), trials by rank."""
        here = left["idx"].to_numpy() >= 0
        reps_, row = np.unique(left["rep"].to_numpy(), return_inverse=True)
        weight, carried = np.zeros((len(reps_), n)), np.full(len(reps_), -np.inf)
        weight[row[here], left["idx"].to_numpy()[here]] = left["c"].to_numpy()[here]
        carried[row[~here]] = left["c"].to_numpy()[~here]
        ks, col = np.unique(right["k"].to_numpy(), return_inverse=True)
        matrix, mean, se, t = np.zeros((n, len(ks))), np.zeros(len(ks)), np.zeros(len(ks)), np.zeros(len(ks))
        matrix[right["idx"].to_numpy(), col] = right["v"].to_numpy()
        mean[col], se[col], t[col] = right["mean"].to_numpy(), right["se"].to_numpy(), right["t"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            bt = np.where(se > 0, (weight @ matrix / n - mean) / se, 0.0)
        return reps_, carried, ks, t, bt

    def tops(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"rep": [], "rb": [], "tb": [], "most": []})
        reps_, _, _, _, bt = centred(left, right)
        return pd.DataFrame({"rep": reps_, "rb": int(left["rb"].iloc[0]), "tb": int(left["tb"].iloc[0]), "most": bt.max(axis=1)})

    def hits(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"k": [], "hits": []})
        _, carried, ks, t, bt = centred(left, right)
        rest = np.maximum(np.maximum.accumulate(bt[:, ::-1], axis=1)[:, ::-1], carried[:, None])
        return pd.DataFrame({"k": ks, "hits": (rest >= t).sum(axis=0)})

    keys = ["rb", "tb"]
    most = c.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(tops, "rep bigint, rb int, tb int, most double")
    behind = W.partitionBy("rep").orderBy(F.col("tb").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = most.select("rep", F.lit(-1).cast("bigint").alias("idx"), F.max("most").over(behind).alias("c"), *keys).where("c is not null")
    both = c.select("rep", F.col("idx").cast("bigint").alias("idx"), "c", *keys).unionByName(carried)
    found = both.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(hits, "k bigint, hits bigint").groupBy("k").agg(F.sum("hits").alias("hits"))
    p = ranked.join(found, "k", "left").select("trial", "t", "k", ((F.coalesce("hits", F.lit(0)) + 1.0) / (reps + 1.0)).alias("raw"))
    up = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # one row for each trial
    return p.select("trial", "t", "raw", F.least(F.lit(1.0), F.max("raw").over(up)).alias("p_rw"))


def sharpe_influence(m: np.ndarray, per_year: float = 252.0) -> tuple[np.ndarray, np.ndarray]:
    """Annual Sharpe of each row and the influence of each value on it (values on the last axis)."""
    mean = m.mean(axis=-1, keepdims=True)
    c = m - mean
    var = (c * c).mean(axis=-1, keepdims=True)
    sd = np.sqrt(var)
    n = m.shape[-1]
    est = per_year**0.5 * mean[..., 0] / (sd[..., 0] * (n / (n - 1.0)) ** 0.5)
    return est, per_year**0.5 * (c / sd - mean * (c * c - var) / (2.0 * sd**3))


def hac_errors(infl: np.ndarray, lags: int) -> np.ndarray:
    """Bartlett standard error of the mean of each row."""
    g, n = infl - infl.mean(axis=-1, keepdims=True), infl.shape[-1]
    lrv = (g * g).mean(axis=-1)
    for k in range(1, lags + 1):
        lrv = lrv + 2.0 * (1.0 - k / (lags + 1.0)) * (g[..., k:] * g[..., :-k]).sum(axis=-1) / n
    return np.sqrt(np.maximum(lrv, 0.0) / n)


def studentized_sharpe(pairs: DataFrame, paths: DataFrame, lags: int, confidence: float = 0.95, trial_blocks: int = 8) -> DataFrame:
    """Studentised interval of the annual Sharpe, or of its difference to a benchmark, for each (trial, benchmark).

    `pairs` has arrays `xs` and `bs` of as many sessions as the paths have; `bs` is null where there is no benchmark. A path draws both
    series at once, and the error of a difference is that of the difference of the influences, so cross terms of the two
    series at every lag are in it. Reps meet trials in (rep block, trial block) groups; a group holds 64 paths and its
    trials' values.
    """
    path_rows = paths.groupBy("rep").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda s: s["idx"]).alias("path"))
    blocks = path_rows.withColumn("rb", F.floor(F.col("rep") / 64).cast("int"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        idx = np.vstack(left["path"].to_numpy()) if len(left) else np.zeros((0, 1), int)
        for trial, name, xs, bs in zip(right["trial"], right["benchmark"], right["xs"], right["bs"], strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                est, infl, b, drawn = 0.0, 0.0, 0.0, 0.0
                for sign, series in ((1.0, xs), (-1.0, bs)):
                    if series is not None:
                        x = np.asarray(series, float)
                        own, again = sharpe_influence(x), sharpe_influence(x[idx])
                        est, infl, b, drawn = est + sign * own[0], infl + sign * own[1], b + sign * again[0], drawn + sign * again[1]
                se, bse = hac_errors(infl, lags), hac_errors(drawn, lags)
                z = np.where(bse > 0, (b - est) / bse, np.nan)
            out += [(trial, name, float(est), float(se), float(v)) for v in z]
        return pd.DataFrame(out, columns=["trial", "benchmark", "estimate", "se", "z"])

    every = blocks.agg(F.max("rb").alias("top"))
    right = pairs.join(F.broadcast(every)).select(
        "trial", "benchmark", "xs", "bs", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("rb"), F.pmod(F.xxhash64("trial"), F.lit(trial_blocks)).cast("int").alias("tb"))
    left = blocks.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(trial_blocks - 1))))
    z = left.groupBy("rb", "tb").cogroup(right.groupBy("rb", "tb")).applyInPandas(
        run, "trial string, benchmark string, estimate double, se double, z double").where("not isnan(z)")
    a = (1.0 - confidence) / 2.0
    x = z.groupBy("trial", "benchmark", "estimate", "se").agg(
        F.percentile("z", F.lit(a)).alias("lo"), F.percentile("z", F.lit(1 - a)).alias("hi"),
        ((F.count_if(F.abs("z") >= F.abs(F.col("estimate") / F.col("se"))) + 1.0) / (F.count("*") + 1.0)).alias("p"))
    return x.select("trial", "benchmark", "estimate", "se", (F.col("estimate") - F.col("hi") * F.col("se")).alias("lower"),
                    (F.col("estimate") - F.col("lo") * F.col("se")).alias("upper"), "p")


def paired_arrays(streams: DataFrame, value: str, benchmarks: DataFrame | None = None) -> DataFrame:
    """(trial, benchmark, xs, bs) in session order. `benchmarks` has (benchmark, pos, b); sessions on which a value of
    the pair is missing are left out of both. The pair NONE has no second series."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = streams.where(ok(value)).select("trial", "pos", F.col(value).cast("double").alias("v"))
    rows = x.select("trial", F.lit("NONE").alias("benchmark"), "pos", "v", F.lit(None).cast("double").alias("b"))
    if benchmarks is not None:
        rows = rows.unionByName(x.join(benchmarks.where(ok("b")), "pos").select("trial", "benchmark", "pos", "v", F.col("b").cast("double").alias("b")))
    g = rows.groupBy("trial", "benchmark").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "b"))).alias("s"))
    bs = F.when(F.col("benchmark") != "NONE", F.transform("s", lambda r: r["b"]))
    return g.select("trial", "benchmark", F.transform("s", lambda r: r["v"]).alias("xs"), bs.alias("bs"))


def resampled_statistic(counts: DataFrame, values: DataFrame, statistic) -> DataFrame:
    """A user's statistic of each resample: a grouped-aggregate pandas UDF over values repeated by count."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series, c: pd.Series) -> float:
        return float(statistic(np.repeat(v.to_numpy(float), c.to_numpy(int))))

    return counts.join(values, "idx").groupBy("trial", "rep").agg(run("v", "c").alias("statistic"))
