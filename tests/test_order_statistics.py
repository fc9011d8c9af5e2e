"""Ranks and quantiles of the past, and selected quantiles, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import expanding as EX
from chronopanel.operators.selection import exact_quantiles

SCHEMA = "symbol string, pos int, x double"


def series(seed=5, n=700):
    rng = np.random.default_rng(seed)
    out = []
    for name, values in (("ties", np.round(rng.standard_normal(n), 1)), ("free", rng.standard_normal(n)), ("flat", np.zeros(40)), ("up", np.arange(600.0))):
        for i, v in enumerate(values):
            if rng.random() < 0.05:
                continue  # a session without a row
            out.append((name, i + 1, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.02 else float(v)))
    return out + [("empty", 3, None), ("one", 9, 1.5)]


def plain(rows, minimum, quantiles):
    out, past = {}, {}
    for name, pos, x in sorted(rows, key=lambda r: (r[0], r[1])):
        seen = past.setdefault(name, [])
        ok = x is not None and np.isfinite(x)
        rank = None
        if ok and len(seen) >= minimum:
            rank = (sum(v < x for v in seen) + sum(v == x for v in seen) / 2) / (len(seen) + 1)
        q = [float(np.quantile(seen, p)) if len(seen) >= max(1, minimum) else None for p in quantiles]
        out[name, pos] = (rank, *q)
        if ok:
            seen.append(x)
    return out


@pytest.mark.parametrize("minimum", [0, 30])
def test_expanding_statistics(spark, minimum):
    rows = series()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = plain(rows, minimum, [0.0, 2 / 3, 0.9])
    ranks = {(r.symbol, r.pos): r.percentile for r in EX.expanding_percentile(df, "x", minimum).collect()}
    q = {(r.symbol, r.pos): (r.a, r.b, r.c) for r in EX.expanding_quantiles(df, "x", {"a": 0.0, "b": 2 / 3, "c": 0.9}, minimum).collect()}
    assert ranks.keys() == q.keys() == want.keys()
    for k, (rank, *values) in want.items():
        assert ranks[k] == pytest.approx(rank, abs=1e-12) if rank is not None else ranks[k] is None
        assert q[k] == pytest.approx(values, abs=1e-12) if values[0] is not None else q[k] == (None, None, None)


def test_no_task_holds_a_series(spark):
    """A node is cut into runs of the calendar, and every row of a pass is in one of them."""
    df = spark.range(4 * EX.RUN).select(F.lit("M").alias("symbol"), F.col("id").cast("int").alias("pos"), F.lit(0).alias("level"), F.lit(0).alias("node"), (F.col("id") % 16).alias("digit"))
    plan = EX.counts_before(df, ["symbol"], "pos")._jdf.queryExecution().executedPlan().toString()
    ranges = [line for line in plan.splitlines() if "Window [" in line and "RangeFrame" in line]
    assert ranges and all("_run" in line for line in ranges)
    out = EX.counts_before(df, ["symbol"], "pos").where(f"pos = {3 * EX.RUN + 17}").first()
    assert out.before == [3 * EX.RUN // 16 + (d < 17 % 16) + 1 for d in range(16)]


@pytest.mark.parametrize("cells,few", [(32, 5), (4096, 100_000)])
def test_selected_quantiles(spark, cells, few):
    rng = np.random.default_rng(2)
    groups = {"heavy": np.r_[np.full(400, 2.0), rng.standard_normal(500)], "wide": np.exp(rng.standard_normal(300) * 20), "one": np.array([4.0]), "two": np.array([1.0, 9.0]), "flat": np.full(9, -3.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("heavy", None), ("heavy", float("nan")), ("none", None)]
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", probs, cells, few).collect()
    assert len(got) == len(groups) * len(probs)
    for r in got:
        assert r["quantile"] == pytest.approx(float(np.quantile(groups[r.g], r.p)), rel=1e-12, abs=1e-12)
