"""Hand values and brute-force comparisons for inference."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.functions.distributions import normal_cdf_array, student_sf_array
from chronopanel.operators import bootstrap as B
from chronopanel.operators import inference as I
from chronopanel.operators import validation as V


def test_student_and_normal_known_values():
    got = student_sf_array(np.array([0.0, 2.0, 1.812461, -2.0, 12.7062]), np.array([5.0, 10.0, 10.0, 10.0, 1.0]))
    assert got == pytest.approx([0.5, 0.036694, 0.05, 0.963306, 0.025], abs=1e-5)
    assert normal_cdf_array(np.array([0.0, 1.959964])) == pytest.approx([0.5, 0.975], abs=1e-6)


def test_hac_with_zero_lags_is_the_plain_error(spark):
    x = [0.01, -0.02, 0.03, 0.00, 0.02, -0.01]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, pos int, v double")
    row = I.hac(df, ["k"], "pos", "v", requested=0).first()
    assert row["se"] == pytest.approx(math.sqrt(np.mean((np.array(x) - np.mean(x)) ** 2) / 6))
    assert row["t"] == pytest.approx(np.mean(x) / row["se"])


def test_hac_matches_a_direct_sum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300).cumsum() * 0.01 + rng.normal(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, pos int, v double")
    row = I.hac(df, ["k"], "pos", "v").first()
    c, lags = x - x.mean(), int(4 * 3 ** (2 / 9))
    lrv = c @ c / 300 + sum(2 * (1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / 300 for k in range(1, lags + 1))
    assert row["lags"] == lags and row["t"] == pytest.approx(x.mean() / math.sqrt(lrv / 300))


def test_constant_stream_has_infinite_t(spark):
    df = spark.createDataFrame([("a", i, 0.5) for i in range(10)] + [("z", i, 0.0) for i in range(10)], "k string, pos int, v double")
    got = {r["k"]: r["t"] for r in I.hac(df, ["k"], "pos", "v").collect()}
    assert got == {"a": math.inf, "z": 0.0}


def test_adjusted_p_hand_values(spark):
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate([0.001, 0.01, 0.03, 0.20])], "trial string, p double")
    got = {r["p"]: (r["p_bh"], r["reject_bonf"]) for r in I.bonferroni(I.benjamini_hochberg(df)).collect()}
    assert {k: round(v[0], 12) for k, v in got.items()} == {0.001: 0.004, 0.01: 0.02, 0.03: 0.04, 0.20: 0.20}
    assert sum(v[1] for v in got.values()) == 2


def test_bh_equals_sorted_definition_with_ties_and_ones(spark):
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.uniform(size=400) ** 6, np.ones(300), np.repeat(0.01, 50), [0.0]])
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(p)], "trial string, p double")
    got = I.benjamini_hochberg(df).toPandas().set_index("trial")["p_bh"]
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate(raw[::-1])[::-1].clip(0, 1)
    assert np.allclose(got.loc[[str(i) for i in range(len(p))]].to_numpy(), want)


def test_skewness_and_kurtosis_are_bias_corrected(spark):
    x = np.array([1.0, 2.0, 2.5, 4.0, 9.0])
    df = spark.createDataFrame([("a", float(v)) for v in x], "k string, v double")
    row = I.summarize(df, ["k"], "v").first()
    s = pd.Series(x)
    assert row["skew"] == pytest.approx(s.skew()) and row["kurtosis"] == pytest.approx(s.kurt() + 3)


def family_fixture(spark, n=120, trials=5):
    rng = np.random.default_rng(5)
    rows = [(f"t{j}", i, float(rng.normal(0.3 if j == 0 else 0.0, 1.0))) for j in range(trials) for i in range(n)]
    return spark.createDataFrame(rows, "trial string, pos int, net double")


def test_blocked_maxima_do_not_depend_on_blocks_and_equal_the_join(spark):
    s = family_fixture(spark)
    v = B.indexed(s, "net")
    counts = B.date_counts(B.stationary_paths(spark, 120, 40))
    fam = B.family_inputs(v, 120)
    one = B.blocked_maxima(counts, v, fam, 120).groupBy("rep").agg(F.max("reality").alias("m")).orderBy("rep").toPandas()["m"]
    many = B.blocked_maxima(counts, v, fam, 120, rep_block=7, trial_blocks=3).groupBy("rep").agg(F.max("reality").alias("m")).orderBy("rep").toPandas()["m"]
    joined = B.resampled_means(counts, v, 120).withColumnRenamed("mean", "b").join(fam, "trial").groupBy("rep").agg(
        F.max(F.col("b") - F.col("mean")).alias("m")).orderBy("rep").toPandas()["m"]
    assert np.allclose(one, many) and np.allclose(one, joined)


def test_blocked_sums_equal_the_join(spark):
    v = B.indexed(family_fixture(spark), "net")
    counts = B.date_counts(B.stationary_paths(spark, 120, 40))
    joined = B.percentile_intervals(counts, v, 120).orderBy("trial").toPandas()
    for blocks in (dict(), dict(rep_block=7, trial_blocks=3)):
        out = B.intervals_of_sums(B.blocked_sums(counts, v, 120, **blocks), 120).orderBy("trial").toPandas()
        assert list(out["trial"]) == list(joined["trial"]) and list(out["n_reps"]) == [40] * len(out)
        assert np.allclose(out.drop(columns=["trial"]), joined.drop(columns=["trial"]))


def test_answers_without_an_oracle_take_the_declared_draws(spark, sf):
    from chronopanel.plans import load, validation

    n = load()["user_statistic_of_resamples"].run(spark, sf).select("rep").distinct().count()
    assert n == 2000
    assert validation.declared_intervals(spark, sf).select("n_reps").distinct().collect() == [(2000,)]
    assert validation.declared_family_tests(spark, sf).first()["n_reps"] == 10000


def test_stepdown_rejects_only_the_planted_strategy(spark):
    s = family_fixture(spark, 300, 3)
    v = B.indexed(s, "net")
    counts = B.date_counts(B.stationary_paths(spark, 300, 200))
    out = B.romano_wolf(B.resampled_means(counts, v, 300), B.family_inputs(v, 300), 200).toPandas().set_index("trial")["p_rw"]
    assert out["t0"] < 0.05 and out["t1"] > 0.05 and out["t2"] > 0.05


def test_model_study_runs_all_folds_of_the_fold_table(spark, sf, monkeypatch):
    from chronopanel.plans import models

    years, seen = models.expanding_folds, []
    monkeypatch.setattr(models, "expanding_folds", lambda df, n: years(df, n - 3))
    monkeypatch.setattr(models.R, "purged_study", lambda frame, folds, specs, ids: (None, seen.append((folds, ids))))
    models.purged_model_study(spark, sf)
    folds, ids = seen[0]
    assert sorted(r["fold"] for r in folds.collect()) == ids and len(ids) > 2


def test_paths_have_the_block_structure(spark):
    p = B.stationary_paths(spark, 50, 30).orderBy("rep", "pos").toPandas()
    assert p["idx"].between(0, 49).all() and len(p) == 1500
    step = p.groupby("rep")["idx"].diff().dropna().mod(50)
    assert 0.8 < (step == 1).mean() < 0.98


def test_purged_splits_keep_train_away_from_test():
    rows = V.purged_splits(60, 6, 2, 3, 4)
    assert len({r[0] for r in rows}) == 15
    adjacent = [r for r in rows if r[0] == 0]
    assert adjacent == [(0, 0, 20, 0, 24)]


def test_overfitting_of_a_dominant_trial_is_zero(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{j}", i, float(rng.normal(0.5 if j == 0 else 0, 0.1))) for j in range(4) for i in range(120)]
    s = spark.createDataFrame(rows, "trial string, pos int, net double")
    per = V.overfitting(V.split_performance(s, V.split_sides(spark, 120, purge=2, embargo=2)))
    assert V.pbo(per).first()["pbo"] == 0.0 and {r["selected"] for r in per.collect()} == {"t0"}


def test_verdict_precedence(spark):
    """One row per level: the first level with a failed gate decides and lists its gates."""
    from chronopanel.operators import validation as V

    good = dict(enough=True, t=4.0, p_bh=0.01, dsr=0.99, spa_p=0.01, is_control=False, mean=1e-3, gross_mean=2e-3, oos_t=2.5, positive_fraction=0.8, stability=0.9, pbo=0.1, agrees=True, decay="STABLE")
    cases = {
        "a": ({}, "WORKS", "ALL_GATES"), "b": ({"enough": False, "t": 0.0}, "WEAK", "FEW_DATES"), "c": ({"t": 3.0, "p_bh": 0.2}, "FALSE_POSITIVE", "T_STAT,FDR"),
        "d": ({"dsr": 0.95, "spa_p": 0.06}, "FALSE_POSITIVE", "DEFLATED_SHARPE,FAMILY_TEST"), "e": ({"is_control": True, "decay": "DEAD"}, "FALSE_POSITIVE", "CONTROL"),
        "f": ({"decay": "DEAD", "oos_t": 0.0}, "DEAD", "RECENT_WINDOWS"), "g": ({"mean": -1e-4}, "WEAK", "NET_MEAN,COSTS"), "h": ({"oos_t": 2.0, "positive_fraction": 0.5, "stability": 0.7}, "WEAK", "OOS_T,OOS_SHARE,STABILITY"),
        "i": ({"pbo": 0.2, "agrees": False, "decay": "DECAYING"}, "WEAK", "OVERFIT,NOT_CONFIRMED,DECAY"), "j": ({"decay": "REGIME_DEPENDENT", "pbo": None, "agrees": None}, "WORKS", "ALL_GATES"), "k": ({"oos_t": None}, "WEAK", "OOS_T"),
    }
    kinds = "trial string, enough boolean, t double, p_bh double, dsr double, spa_p double, is_control boolean, mean double, gross_mean double, oos_t double, positive_fraction double, stability double, pbo double, agrees boolean, decay string"
    df = spark.createDataFrame([(k, *(good | change).values()) for k, (change, _, _) in cases.items()], kinds)
    got = {r["trial"]: (r["verdict"], r["reasons"]) for r in V.verdicts(df).collect()}
    assert got == {k: (v, r) for k, (_, v, r) in cases.items()}


def test_outcome_before_the_last_observation_is_refused(spark):
    from chronopanel.operators import paper as PA

    rows = spark.createDataFrame([("a", 0.1, 5.0, "2024-01-05"), ("b", 0.2, 6.0, "2024-01-03"), ("c", 0.3, None, None)], "recommendation_id string, ret double, exit_price double, exit_at string")
    seen = spark.createDataFrame([("a", "2024-01-04"), ("b", "2024-01-04")], "recommendation_id string, seen_at string")
    assert [r["recommendation_id"] for r in PA.outcomes(rows, last_seen=seen).collect()] == ["a"]


def test_blocked_stepdown_equals_the_join(spark):
    rng = np.random.default_rng(12)
    rows = [(f"t{k}", i, float(rng.standard_normal() * 0.01 + (0.004 if k == 2 else 0.0))) for k in range(9) for i in range(90)]
    v = spark.createDataFrame(rows, "trial string, idx int, v double")
    counts = B.date_counts(B.stationary_paths(spark, 90, 130))
    fam = B.family_inputs(v, 90)
    want = {r.trial: (r.raw, r.p_rw) for r in B.romano_wolf(B.resampled_means(counts, v, 90), fam, 130).collect()}
    for rep_block, trial_block in ((512, 256), (50, 2)):
        got = {r.trial: (r.raw, r.p_rw) for r in B.blocked_stepdown(counts, v, fam, 90, 130, rep_block, trial_block).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_declared_gates(spark):
    rows = [("good", 500, 0.01, 4.0, 1e-5, 0.99), ("weak_t", 500, 0.01, 2.9, 1e-5, 0.99), ("few", 99, 0.01, 4.0, 1e-5, 0.99), ("negative", 500, -0.01, -4.0, 1e-5, 0.99), ("lucky", 500, 0.01, 4.0, 1e-5, 0.9), ("null", 500, 0.01, None, None, None)]
    got = {r.trial: r for r in I.gauntlet(spark.createDataFrame(rows, "trial string, n long, mean double, t double, p double, dsr double")).collect()}
    assert {k for k, r in got.items() if r.survivor} == {"good"}
    assert not got["weak_t"].gate_t and not got["few"].gate_sample and got["few"].p_gate == 1.0 and not got["lucky"].gate_dsr and not got["negative"].gate_sign
