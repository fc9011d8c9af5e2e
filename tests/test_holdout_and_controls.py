"""The sealed window's gates, studentised Sharpe differences and paired controls, by hand values and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import bootstrap as B
from chronopanel.operators import controls as C
from chronopanel.operators import holdout as H

ROWS = "kind string, series string, n long, mean double, mean_low double"


def decided(spark, rows, profile="full"):
    return {r.evaluator: r for r in H.decide(spark.createDataFrame(rows, ROWS), profile).collect()}


def test_gates_of_the_window(spark):
    good = [("EDGE", "a", 50, 0.1, 0.01), ("EDGE", "b", 50, 0.2, 0.02), ("COMPOSITE", "ALL", 50, 0.15, 0.05), ("OVERLAY", "T", 50, 0.0, -0.1)]
    d = decided(spark, good)
    assert all(d[k].research_gate_pass and d[k].promoted for k in d)
    assert d["SIGN_V1"].edge_low_positive is None and d["CI_V2"].edge_low_positive
    assert not decided(spark, good, "smoke")["CI_V2"].promoted
    short = [good[0], ("EDGE", "b", 5, 0.2, None), *good[2:]]  # no interval fails closed
    d = decided(spark, short)
    assert d["SIGN_V1"].research_gate_pass and not d["CI_V2"].research_gate_pass and not d["CI_V2"].edge_low_positive
    report = H.diagnostic(H.decide(spark.createDataFrame(short, ROWS))).first()
    assert (report.sealed_pass, report.ci_v2_would_pass, report.composite_low_positive) == (True, False, True)
    assert not decided(spark, [*good[:3], ("OVERLAY", "T", 50, -1e-9, 0.1)])["SIGN_V1"].overlays_nonnegative
    assert not decided(spark, good[:2])["SIGN_V1"].composite_positive  # edges without a composite
    none = decided(spark, [])
    assert none["CI_V2"].research_gate_pass and not none["CI_V2"].promoted


def test_intervals_of_the_window_share_their_paths(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(60) + 0.2, rng.standard_normal(60)
    rows = [(k, s, i + 100, float(v)) for k, s, vs in (("EDGE", "a", a), ("EDGE", "b", b), ("COMPOSITE", "ALL", (a + b) / 2), ("OVERLAY", "T", a[:10])) for i, v in enumerate(vs)]
    window = spark.createDataFrame([(i + 100, i) for i in range(60)], "pos int, idx long")
    got = {r.series: r for r in H.evaluate(spark.createDataFrame(rows, "kind string, series string, pos int, v double"), window, 80).collect()}
    paths = np.array([[r.idx for r in g] for _, g in _grouped(B.stationary_paths(spark, 60, 80).collect())])
    for name, x in (("a", a), ("b", b), ("ALL", (a + b) / 2)):
        assert [got[name].mean_low, got[name].mean_high] == pytest.approx(np.quantile(x[paths].mean(1), [0.025, 0.975]).tolist())
    assert got["T"].n == 10 and got["T"].mean_low is None


def _grouped(rows):
    from itertools import groupby

    return [(k, list(g)) for k, g in groupby(sorted(rows, key=lambda r: (r.rep, r.pos)), key=lambda r: r.rep)]


def test_studentised_difference(spark):
    rng = np.random.default_rng(4)
    n, lags = 50, 3
    x = rng.standard_normal(n) * 0.01 + 0.002
    y = 0.5 * x + rng.standard_normal(n) * 0.01
    rows = [("t", i, float(v)) for i, v in enumerate(x)] + [("t", 99, None), ("u", 98, 0.1)]
    bench = [("M", i, float(v)) for i, v in enumerate(y)] + [("M", 99, 0.3), ("M", 98, None)]
    pairs = B.paired_arrays(spark.createDataFrame(rows, "trial string, pos int, net double"), "net", spark.createDataFrame(bench, "benchmark string, pos int, b double"))
    kept = {(r.trial, r.benchmark): (len(r.xs), None if r.bs is None else len(r.bs)) for r in pairs.collect()}
    assert kept == {("t", "NONE"): (n, None), ("t", "M"): (n, n), ("u", "NONE"): (1, None)}

    def stats(v):
        m, sd0 = v.mean(), v.std()
        sharpe = 252**0.5 * m / v.std(ddof=1)
        return sharpe, 252**0.5 * ((v - m) / sd0 - m * ((v - m) ** 2 - sd0**2) / (2 * sd0**3))

    def error(g):
        g = g - g.mean()
        lrv = (g @ g + 2 * sum((1 - k / (lags + 1)) * (g[k:] @ g[:-k]) for k in range(1, lags + 1))) / n
        return (max(lrv, 0) / n) ** 0.5

    paths = B.stationary_paths(spark, n, 60)
    got = {r.benchmark: r for r in B.studentized_sharpe(pairs.where("trial = 't'"), paths, lags, trial_blocks=3).collect()}
    idx = np.array([[r.idx for r in g] for _, g in _grouped(paths.collect())])
    for name, other in (("NONE", None), ("M", y)):
        def both(rows_, other=other):
            a = stats(x[rows_])
            return a if other is None else tuple(p - q for p, q in zip(a, stats(other[rows_])))

        est, infl = both(np.arange(n))
        se = error(infl)
        z = np.array([(e - est) / error(g) for e, g in (both(i) for i in idx)])
        lo, hi = np.quantile(z, [0.025, 0.975])
        want = (est, se, est - hi * se, est - lo * se, (1 + (np.abs(z) >= abs(est / se)).sum()) / (len(z) + 1))
        assert (got[name].estimate, got[name].se, got[name].lower, got[name].upper, got[name].p) == pytest.approx(want, rel=1e-9)


def test_controls_keep_what_they_declare(spark):
    rng = np.random.default_rng(8)
    names, days = [f"S{i}" for i in range(7)], 40
    cal = spark.createDataFrame([(i + 1, None) for i in range(days)], "pos int, session date").withColumn("session", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos")))
    weights = {(t, s, p): float(rng.integers(-2, 3)) for t in ("x", "y") for s in names[:4] for p in range(3, days + 1)}
    rows = [(t, s, p, w, weights.get((t, s, p - 1), 0.0)) for (t, s, p), w in weights.items()]
    held = spark.createDataFrame(rows, "trial string, symbol string, pos int, weight double, previous double")
    x = C.with_control_positions(held, cal, spark.createDataFrame([(n,) for n in names], "symbol string")).collect()
    by = {}
    for r in x:
        by.setdefault(r.trial, []).append(r)
    assert sorted(by) == sorted(f"{t}{k}" for t in ("x", "y") for k in ("", "|SHUFFLED_DATES", "|MATCHED_RANDOM"))
    exposure = lambda rs: sorted((r.pos, r.weight, r.previous) for r in rs)
    for t in ("x", "y"):
        assert exposure(by[t]) == exposure(by[t + "|SHUFFLED_DATES"]) == exposure(by[t + "|MATCHED_RANDOM"])
        turned = {r.pos: {q.from_pos for q in by[t + "|SHUFFLED_DATES"] if q.pos == r.pos} for r in by[t]}
        assert all(len(v) == 1 for v in turned.values()) and len({min(v) for v in turned.values()}) == len(turned)
        assert {r.symbol for r in by[t + "|SHUFFLED_DATES"]} == set(names[:4]) and all(r.pos == r.from_pos for r in by[t + "|MATCHED_RANDOM"])
        assert len({r.symbol for r in by[t + "|MATCHED_RANDOM"]}) == 4
    assert {r.from_pos for r in by["x|SHUFFLED_DATES"] if r.pos == 5} != {r.from_pos for r in by["y|SHUFFLED_DATES"] if r.pos == 5}
