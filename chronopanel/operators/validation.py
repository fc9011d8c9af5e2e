"""Folds, decay, overfitting and causality checks over long stream tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .inference import benjamini_hochberg, hac, regime_interaction, with_p

YEAR = 12


def span(df: DataFrame, day: str = "session") -> DataFrame:
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))


def expanding_folds(df: DataFrame, train_years: int = 5, test_years: int = 1, step_years: int = 1) -> DataFrame:
    """(fold, test_start, test_stop) on calendar years from the first session; one row per year."""
    starts = F.sequence(F.lit(0), F.lit(200)).alias("ks")
    x = span(df).select("lo", "hi", F.explode(starts).alias("fold"))
    begin = F.add_months("lo", F.lit(train_years * YEAR) + F.col("fold") * (step_years * YEAR))
    x = x.withColumn("test_start", begin).where("test_start <= hi")
    return x.select("fold", "test_start", F.add_months("test_start", test_years * YEAR).alias("test_stop"))


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows by fold and side. The fold table has one row per calendar year, so it is broadcast."""
    f = F.broadcast(folds)
    side = F.when(F.col("session") < F.col("test_start"), "train").otherwise("test")
    return df.join(f, F.col("session") < F.col("test_stop")).withColumn("side", side)


def walk_forward(streams: DataFrame, folds: DataFrame, value: str = "net", holding: int = 1) -> DataFrame:
    """HAC test per trial, fold and side."""
    return hac(fold_rows(streams, folds), ["trial", "fold", "side"], "pos", value, holding)


def stitched(streams: DataFrame, folds: DataFrame) -> DataFrame:
    """Out-of-sample rows, each owned by the first fold that tests it."""
    rows = streams.join(F.broadcast(folds), (F.col("session") >= F.col("test_start")) & (F.col("session") < F.col("test_stop")))
    return rows.groupBy("trial", "pos", "session").agg(F.min("fold").alias("fold"), F.first("net").alias("net"))


def walk_forward_verdict(streams: DataFrame, folds: DataFrame, value: str = "net", holding: int = 1, t_min: float = 2.0) -> DataFrame:
    per_fold = walk_forward(streams, folds, value, holding).where("side = 'test'")
    share = per_fold.groupBy("trial").agg(
        F.count("*").alias("n_folds"), F.avg((F.col("mean") > 0).cast("double")).alias("positive_fraction"))
    whole = hac(stitched(streams, folds), ["trial"], "pos", value, holding).select(
        "trial", F.col("n").alias("n_oos"), F.col("mean").alias("oos_mean"), F.col("t").alias("oos_t"))
    x = share.join(whole, "trial")
    return x.withColumn("majority", F.col("positive_fraction") > 0.5).withColumn("significant", F.col("oos_t") > t_min)


def window_table(df: DataFrame, years: int, step_months: int) -> DataFrame:
    """(w, start, stop) of calendar windows that end inside the sample."""
    x = span(df).select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(2400 // step_months))).alias("w"))
    x = x.select("w", "hi", F.add_months("lo", F.col("w") * step_months + years * YEAR).alias("stop"))
    return x.where("stop <= date_add(hi, 1)").select("w", F.add_months("stop", -years * YEAR).alias("start"), "stop")


def decay_points(streams: DataFrame, years: int = 5, step_months: int = 12, value: str = "net", holding: int = 1, minimum: int = 100) -> DataFrame:
    """HAC mean and t per trial and window; disjoint windows when the step equals the length."""
    windows = F.broadcast(window_table(streams, years, step_months))
    x = streams.join(windows, (F.col("session") >= F.col("start")) & (F.col("session") < F.col("stop")))
    ends = x.groupBy("trial", "w").agg(F.min("session").alias("window_start"), F.max("session").alias("window_end"))
    return hac(x, ["trial", "w"], "pos", value, holding).where(F.col("n") >= minimum).join(ends, ["trial", "w"])


def regime_evidence(streams: DataFrame, regime: DataFrame, value: str = "net", holding: int = 1) -> DataFrame:
    """(trial, p_interaction, active_t): the interaction's p adjusted over the whole family, and the t inside the regime."""
    x = streams.join(regime, "pos")
    tests = regime_interaction(x, ["trial"], "pos", value, "on", holding).select("trial", "n", "t")
    family = benjamini_hochberg(with_p(tests).withColumn("p", F.coalesce("p", F.lit(1.0))), "p").select("trial", F.col("p_bh").alias("p_interaction"))
    active = hac(x.where("on"), ["trial"], "pos", value, holding).select("trial", F.col("t").alias("active_t"))
    return family.join(active, "trial", "left")


def classify_decay(rolling: DataFrame, fixed: DataFrame, stability_min: float = 0.75, sign: int = 1, regime: DataFrame | None = None) -> DataFrame:
    """STABLE, DECAYING, DEAD, REGIME_DEPENDENT or INSUFFICIENT per trial. A trial has one row per window (years).

    Means and t are taken in the direction of `sign`. Death comes first; with the evidence of a `regime`, an adjusted
    interaction below 0.05 with a directed t above 2 inside the regime comes before the other classes.
    """
    back = W.partitionBy("trial").orderBy(F.col("w").desc())
    rolling, fixed = (d.withColumn("mean", F.col("mean") * sign).withColumn("t", F.col("t") * sign) for d in (rolling, fixed))
    x = rolling.withColumn("r", F.row_number().over(back)).withColumn("k", F.count("*").over(W.partitionBy("trial")))
    recent, earlier = F.col("r") <= 2, (F.col("r") > 2) & (F.col("t") > 3)
    s = x.groupBy("trial").agg(
        F.count("*").alias("n_windows"), F.max(F.when(F.col("r") == 1, F.col("mean"))).alias("last_mean"),
        F.percentile(F.when(F.col("r") > 1, F.col("mean")), F.lit(0.5)).alias("prior_median"),
        F.percentile(F.when(earlier, F.col("mean")), F.lit(0.5)).alias("strong_median"),
        F.max(F.when(recent, F.abs("t"))).alias("recent_t"), F.max(F.when(recent, F.abs("mean"))).alias("recent_mean"),
        F.count_if(F.col("mean") > 0).alias("same"))
    g = fixed.groupBy("trial").agg(F.count("*").alias("n_fixed"), F.count_if(F.col("mean") > 0).alias("same_fixed"))
    s = s.join(g, "trial", "left")
    zero, no = F.lit(0), F.lit(False)
    s = s.withColumn("stability", (F.col("same") + F.coalesce("same_fixed", zero)) / (F.col("n_windows") + F.coalesce("n_fixed", zero)))
    s = s.withColumn("ratio", F.when(F.col("prior_median") > 0, F.col("last_mean") / F.col("prior_median")))
    dead = (F.col("n_windows") >= 3) & F.col("strong_median").isNotNull() & (F.col("recent_t") < 1) & (
        F.col("recent_mean") <= F.lit(0.25) * F.abs("strong_median"))
    cls = F.when(F.coalesce(dead, no), "DEAD")
    if regime is not None:
        s = s.join(regime.select("trial", "p_interaction", "active_t"), "trial", "left")
        cls = cls.when(F.coalesce((F.col("p_interaction") < 0.05) & (F.col("active_t") * sign > 2), no), "REGIME_DEPENDENT")
    alive = F.col("last_mean") > 0
    cls = cls.when(F.coalesce((F.col("stability") >= stability_min) & alive & (F.col("ratio") >= 0.5), no), "STABLE")
    return s.withColumn("decay", cls.when(F.coalesce(alive & (F.col("ratio") < 0.5), no), "DECAYING").otherwise("INSUFFICIENT"))


def purged_splits(n: int, groups: int = 6, test_groups: int = 2, purge: int = 21, embargo: int = 21):
    """Test ranges and forbidden training ranges of every combination; plain numbers, no data."""
    from itertools import combinations

    base, extra = divmod(n, groups)
    edges = [g * base + min(g, extra) for g in range(groups + 1)]
    rows = []
    for split, chosen in enumerate(combinations(range(groups), test_groups)):
        runs: list[list[int]] = []
        for g in chosen:
            if runs and runs[-1][1] == g - 1:
                runs[-1][1] = g
            else:
                runs.append([g, g])
        for first, last in runs:
            start, stop = edges[first], edges[last + 1]
            rows.append((split, start, stop, max(0, start - purge), min(n, stop + embargo)))
    return rows


def split_sides(spark, n: int, **settings) -> DataFrame:
    """(split, i, side) for every row number that a split uses; splits x calendar rows."""
    ranges = F.broadcast(spark.createDataFrame(purged_splits(n, **settings), "split int, start int, stop int, no_from int, no_to int"))
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    pairs = i.join(ranges).groupBy("split", "i").agg(
        F.max((F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))).alias("test"),
        F.max((F.col("i") >= F.col("no_from")) & (F.col("i") < F.col("no_to"))).alias("blocked"))
    side = F.when(F.col("test"), "test").when(~F.col("blocked"), "train")
    return pairs.select("split", "i", side.alias("side")).where("side is not null")


def split_performance(streams: DataFrame, sides: DataFrame, value: str = "net") -> DataFrame:
    """(split, trial, train, test) annual Sharpes.

    Rows meet splits on the row number; moments are combined map-side, so the shuffle carries one row per
    (split, trial, side) and task.
    """
    i = (F.row_number().over(W.partitionBy("trial").orderBy("pos")) - 1).cast("int")
    x = streams.select("trial", i.alias("i"), F.col(value).alias("v")).join(F.broadcast(sides), "i")
    m = x.groupBy("split", "trial", "side").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    sharpe = F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * F.lit(252.0**0.5))
    return m.groupBy("split", "trial").agg(
        F.max(F.when(F.col("side") == "train", sharpe)).alias("train"), F.max(F.when(F.col("side") == "test", sharpe)).alias("test"))


def overfitting(perf: DataFrame) -> DataFrame:
    """Per split: the train winner's mid-rank percentile on the test side and its logit.

    A trial without a finite Sharpe in every split has no rank and is left out of all of them.
    """
    flat = perf.where("train is null or test is null").select("trial").distinct()
    perf = perf.join(flat, "trial", "left_anti")
    group = W.partitionBy("split")
    n = F.count("test").over(group)
    below = F.rank().over(group.orderBy("test")) - 1
    ties = F.count("*").over(W.partitionBy("split", "test"))
    x = perf.select("split", "trial", "train", "test", n.alias("n"), ((below + (ties + 1) / 2.0) / n).alias("pct"),
                    F.row_number().over(group.orderBy(F.col("train").desc(), "trial")).alias("r")).where("r = 1")
    eps = 2.220446049250313e-16
    p = F.least(F.greatest("pct", F.lit(eps)), F.lit(1.0 - eps))
    return x.select("split", F.col("trial").alias("selected"), "pct", F.ln(p / (F.lit(1.0) - p)).alias("logit"))


def pbo(per_split: DataFrame) -> DataFrame:
    return per_split.agg(F.count("*").alias("n_splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"))


def purged_panel_folds(frame: DataFrame, folds: DataFrame, purge: int = 5) -> DataFrame:
    """Training rows end before the test starts and lose the last ``purge`` dates; test rows are kept."""
    rows = fold_rows(frame, folds)
    dates = rows.where("side = 'train'").where(F.col("label_end") < F.col("test_start")).select("fold", "session").distinct()
    back = F.row_number().over(W.partitionBy("fold").orderBy(F.col("session").desc()))
    keep = dates.withColumn("_back", back).where(F.col("_back") > purge).drop("_back").withColumn("side", F.lit("train"))
    train = rows.where("side = 'train'").where(F.col("label_end") < F.col("test_start")).join(F.broadcast(keep), ["fold", "session", "side"], "left_semi")
    return train.unionByName(rows.where("side = 'test'").select(*train.columns))


def ranking_diagnostics(frame: DataFrame, predicted: str, realized: str, k: int = 5, by=("session",)) -> DataFrame:
    """Spearman correlation and top-minus-bottom spread per date."""
    from .crosssec import percent_rank_average

    group = W.partitionBy(*by)
    x = frame.where(F.col(predicted).isNotNull() & F.col(realized).isNotNull())
    x = x.select(
        *by, predicted, realized, percent_rank_average(predicted, by).alias("_a"), percent_rank_average(realized, by).alias("_b"),
        F.row_number().over(group.orderBy(F.col(predicted).desc(), "symbol")).alias("_t"),
        F.row_number().over(group.orderBy(F.col(predicted), "symbol")).alias("_u"), F.count("*").over(group).alias("_n"))
    x = x.where(F.col("_n") >= 2 * k)
    r = F.col(realized)
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.corr("_a", "_b").alias("ic"),
        (F.avg(F.when(F.col("_t") <= k, r)) - F.avg(F.when(F.col("_u") <= k, r))).alias("spread"))


@dataclass(frozen=True)
class Gates:
    """Declared thresholds of the verdict; a study states its own by passing another instance."""

    t: float = 3.0
    fdr: float = 0.05
    deflated_sharpe: float = 0.95
    family_p: float = 0.05
    oos_t: float = 2.0
    oos_share: float = 0.5
    stability: float = 0.75
    overfitting: float = 0.20


def verdicts(x: DataFrame, gates: Gates | None = None) -> DataFrame:
    """WORKS, WEAK, FALSE_POSITIVE or DEAD with the failed gates of the deciding level.

    Levels in their order: too few dates; chance (any gate of significance fails); death of a once strong edge;
    weakness. Gates whose evidence is missing fail, but for `pbo` and `agrees`, which may be absent from a study.
    """
    from .filters import reasons

    g = gates or Gates()
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    chance = reasons(
        T_STAT=fails(F.col("t") > g.t), FDR=fails(F.col("p_bh") <= g.fdr), DEFLATED_SHARPE=fails(F.col("dsr") > g.deflated_sharpe),
        FAMILY_TEST=fails(F.col("spa_p") <= g.family_p), CONTROL=F.col("is_control"))
    weak = reasons(
        NET_MEAN=fails(F.col("mean") > 0), COSTS=(F.col("gross_mean") > 0) & fails(F.col("mean") > 0), OOS_T=fails(F.col("oos_t") > g.oos_t),
        OOS_SHARE=fails(F.col("positive_fraction") > g.oos_share), STABILITY=fails(F.col("stability") >= g.stability), OVERFIT=F.coalesce(F.col("pbo") >= g.overfitting, F.lit(False)),
        NOT_CONFIRMED=~F.coalesce(F.col("agrees"), F.lit(True)), DECAY=fails(F.col("decay").isin("STABLE", "REGIME_DEPENDENT")))
    levels = (
        (~F.col("enough"), "WEAK", F.array(F.lit("FEW_DATES"))), (F.size(chance) > 0, "FALSE_POSITIVE", chance),
        (F.col("decay") == "DEAD", "DEAD", F.array(F.lit("RECENT_WINDOWS"))), (F.size(weak) > 0, "WEAK", weak),
    )
    verdict, why = F.lit("WORKS"), F.array(F.lit("ALL_GATES"))
    for rule, name, listed in reversed(levels):
        verdict, why = F.when(rule, name).otherwise(verdict), F.when(rule, listed).otherwise(why)
    return x.select("*", verdict.alias("verdict"), F.array_join(why, ",").alias("reasons"))


def prefix_breaks(build, df: DataFrame, cut, day: str = "session") -> DataFrame:
    """Rows that change when the input is truncated before ``cut``; empty for a causal feature.

    ``build`` is any DataFrame -> DataFrame function that keeps the session column.
    """
    c = F.lit(cut).cast("date")
    full = build(df).where(F.col(day) < c)
    return full.exceptAll(build(df.where(F.col(day) < c)))
