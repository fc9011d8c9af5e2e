"""Planted leaks, trades against daily rows, and decay classes with a regime, by hand values."""

import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.operators import causality as CA
from chronopanel.operators import streams as S
from chronopanel.operators import validation as V


def test_a_plan_that_sees_the_future_is_found(spark):
    """The leaking trial trades on tomorrow's return; the honest one on today's."""
    rows = [(s, p, math.sin(p * 1.7 + k) * 0.02) for k, s in enumerate("abcd") for p in range(1, 161)]
    panel = spark.createDataFrame(rows, "symbol string, pos int, ret double").withColumn("adv20", F.lit(1e8)).withColumn("asset_type", F.lit("equity"))
    cal = panel.select("pos").distinct().withColumn("session", F.date_add(F.lit("2020-01-01").cast("date"), F.col("pos")))

    def build(d, lag):
        w = W.partitionBy("symbol").orderBy("pos")
        x = d.withColumn("next", F.lead("ret").over(w))
        legs = F.array(*[F.struct(F.lit(n).alias("trial"), F.col(c).alias("s")) for n, c in (("honest", "ret"), ("leak", "next"))])
        e = x.select("symbol", "pos", F.inline(legs)).where("s is not null").select("trial", "symbol", "pos", F.signum("s").alias("weight"))
        return S.positions(e, 1, lag)

    def leak_at_the_end(d, lag):  # only the last rows of a panel differ: a window that is scaled by its own end
        top = d.agg(F.max("pos").alias("top"))
        return build(d, lag).join(top).withColumn("weight", F.col("weight") * F.when(F.col("trial") == "leak", F.col("top")).otherwise(1)).drop("top")

    evaluate = lambda x: S.evaluate(x, panel, cal)
    got = {r.trial: r for r in CA.survivor_causality(leak_at_the_end, evaluate, panel, 160, 1, 1).collect()}
    assert got["honest"].causal and got["honest"].n_changed == 0 and got["honest"].n_compared > 400
    assert got["leak"].reason == "CHANGED_WITHOUT_THE_FUTURE" and got["leak"].n_changed == got["leak"].n_compared
    short = CA.survivor_causality(build, evaluate, panel.where("pos <= 70"), 70, 1, 1).collect()
    assert {r.reason for r in short} == {"SAMPLE_TOO_SHORT"} and all(r.causal for r in short)


def test_trades_and_days_agree(spark):
    signal = [0, 1, 1, 0, -1, -1, 1, 1, 0, 0, 1]
    ret = [0.01, 0.02, -0.01, 0.03, 0.01, -0.02, 0.0, 0.01, 0.02, -0.01, 0.05]
    s = spark.createDataFrame([("a", i + 1, float(x)) for i, x in enumerate(signal)] + [("flat", i + 1, 0.0) for i in range(11)], "trial string, pos int, signal double")
    r = spark.createDataFrame([(i + 1, x) for i, x in enumerate(ret)], "pos int, ret double")
    got = {x.trial: x for x in CA.confirm_scalars(s, r, 0.001).collect()}
    held = [0, *signal[:-1]]
    change = [abs(a - b) for a, b in zip(held, [0, *held[:-1]])]
    net = sum(h * x - 0.001 * c for h, x, c in zip(held, ret, change)) / 11
    assert (got["a"].trades, got["a"].vector_trades) == (5, 5)
    assert (got["a"].net_mean, got["a"].vector_mean) == pytest.approx((net, net)) and got["a"].passed
    assert (got["flat"].trades, got["flat"].vector_trades, got["flat"].net_mean) == (0, 0, 0.0) and got["flat"].passed
    segments = CA.trade_segments(s.where("trial = 'a'")).orderBy("first").collect()
    assert [(x.signal, x.first, x.last, x.change) for x in segments] == [(0, 1, 1, 0), (1, 2, 3, 1), (0, 4, 4, 1), (-1, 5, 6, 1), (1, 7, 8, 2), (0, 9, 10, 1), (1, 11, 11, 1)]


def test_regime_comes_after_death_and_before_stability(spark):
    curve = {"dead": [(0.1, 4), (0.1, 4), (0.01, 0.2), (0.01, 0.1)], "steady": [(0.1, 2)] * 4, "bound": [(0.1, 2)] * 4, "weak": [(0.1, 2)] * 4, "down": [(-0.1, -2)] * 4}
    points = spark.createDataFrame([(t, w, m, float(x)) for t, c in curve.items() for w, (m, x) in enumerate(c)], "trial string, w int, mean double, t double")
    none = points.where("false")
    regime = spark.createDataFrame([("dead", 0.01, 5.0), ("bound", 0.01, 3.0), ("weak", 0.01, 1.9), ("down", 0.01, -4.0)], "trial string, p_interaction double, active_t double")
    classes = lambda **kw: {r.trial: r.decay for r in V.classify_decay(points, none, **kw).collect()}
    assert classes(regime=regime) == {"dead": "DEAD", "steady": "STABLE", "bound": "REGIME_DEPENDENT", "weak": "STABLE", "down": "INSUFFICIENT"}
    assert classes()["bound"] == "STABLE"
    assert classes(sign=-1, regime=regime)["down"] == "REGIME_DEPENDENT" and classes(sign=-1)["down"] == "STABLE"
