"""Known effects by hand values; the freshness of surprises."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import monthly as MO
from chronopanel.operators import replication as R

DAY = dt.date(2020, 1, 1)  # a Wednesday


def series(spark, values, name="mkt"):
    rows = [(DAY + dt.timedelta(days=i), i + 1, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"session date, pos int, {name} double")


def test_event_days_and_turn_of_month(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(200) * 0.01
    v[::5] += 0.02
    m = series(spark, [*v, None])
    days = spark.createDataFrame([(DAY + dt.timedelta(days=i),) for i in range(0, 200, 5)] * 2, "event_day date")
    end = DAY + dt.timedelta(days=149)
    got = R.event_day(m, days, str(DAY), str(end)).first()
    past = v[:150:5]
    assert got.passed and got.n == 30 and got.first == pytest.approx(past.mean()) and got.second == pytest.approx(v[150::5].mean())
    assert got.statistic == pytest.approx(past.mean() / (past.std() / np.sqrt(30)))
    flags = m.select("pos", ((F.col("pos") - 1) % 5 == 0).alias("turn_of_month"))
    tom = R.turn_of_month(m, flags).first()
    assert tom.passed and tom.n == 40 and tom.first == pytest.approx(v[::5].mean()) and tom.second == pytest.approx(np.delete(v, np.s_[::5]).mean())
    assert not R.turn_of_month(m.withColumn("mkt", -F.col("mkt")), flags).first().passed


def test_overnight(spark):
    rows = [("a", 100.0, 104.0, 105.0), ("a", 105.0, 110.0, 111.0), ("b", 100.0, 100.5, 104.0), ("b", None, 1.0, 1.0)]
    r = spark.createDataFrame(rows, "symbol string, px1 double, open_adj double, px double")
    both, one = R.overnight_dominance(r).first(), R.overnight_dominance(r.where("symbol = 'a'")).first()
    assert one.passed and one.n == 1 and not both.passed and both.n == 2
    assert both.statistic == pytest.approx(np.log(1.005) - np.log(104 / 100.5)) and both.first == pytest.approx(np.log(1.005) / np.log(1.04))
    falling = spark.createDataFrame([("a", 100.0, 99.0, 90.0)], "symbol string, px1 double, open_adj double, px double")
    assert not R.overnight_dominance(falling).first().passed and R.overnight_dominance(falling).first().first is None


def test_momentum_and_reversal(spark):
    v = [0.01] * 60 + [-0.05] * 5 + [0.01] * 30
    s = series(spark, v, "gross")
    crash = R.momentum_crash(s, "2020-01-01", "2020-12-31", width=5).first()
    assert crash.passed and crash.first == pytest.approx(0.95**5 - 1) and crash.n == 95
    assert not R.momentum_crash(s, "2020-01-01", "2020-02-01", width=5).first().passed
    assert R.momentum_crash(s, "2021-01-01", "2021-02-01").first().first is None
    stream = lambda g, n: spark.createDataFrame([(g, n)] * 3, "gross double, net double")
    assert R.reversal_cost_damage(stream(0.2, 0.1)).first().passed and R.reversal_cost_damage(stream(0.2, -0.1)).first().passed
    assert not R.reversal_cost_damage(stream(0.2, 0.11)).first().passed and not R.reversal_cost_damage(stream(-0.2, -0.3)).first().passed


def test_monday_and_suite(spark):
    rng = np.random.default_rng(3)
    days = [DAY + dt.timedelta(days=i) for i in range(800)]
    v = [rng.standard_normal() * 0.001 - (0.01 if d.weekday() == 0 and i < 400 else 0.0) for i, d in enumerate(days)]
    m = series(spark, v)
    cut = str(days[400])
    got = R.monday_decay(m, cut, cut).first()
    early = np.array(v[:400])[[d.weekday() == 0 for d in days[:400]]].mean() - np.array(v[:400])[[d.weekday() != 0 for d in days[:400]]].mean()
    assert got.passed and got.first == pytest.approx(early) and got.n == sum(d.weekday() == 0 for d in days[400:])
    empty = R.monday_decay(m.limit(0), cut, cut)
    none = empty.first()
    assert not none.passed and none.statistic is None
    flags = m.select("pos", F.lit(True).alias("turn_of_month"))
    nothing = R.turn_of_month(m.limit(0), flags).first()  # a check without data is a row that has not passed
    assert (nothing.passed, nothing.n) == (False, 0) and not R.event_day(m.limit(0), m.select(F.col("session").alias("event_day")), cut, cut).first().passed
    assert {r.promote for r in R.suite(R.monday_decay(m, cut, cut), empty.withColumn("check", F.lit("other"))).collect()} == {False}
    assert {r.promote for r in R.suite(R.monday_decay(m, cut, cut)).collect()} == {True}


def test_surprises_stay_fresh(spark):
    cal = series(spark, [0.0] * 40).select("session", "pos")
    at = lambda i: DAY + dt.timedelta(days=i)
    rows = [("a", 1, 0.5, at(2)), ("a", 2, 0.7, at(12)), ("b", 1, 0.1, at(-90)), ("c", 1, 0.2, at(39)), ("d", 1, 9.0, at(5)), ("d", 2, 8.0, at(5))]
    first = MO.first_usable(spark.createDataFrame(rows, "symbol string, q int, sue double, available date"), "available", cal)
    assert {(r.symbol, r.q): r.first for r in first.collect()} == {("a", 1): 4, ("a", 2): 14, ("b", 1): 1, ("d", 1): 7, ("d", 2): 7}
    ends = cal.where("pos in (10, 20, 30)").select("pos", "session")
    got = {(r.symbol, (r.session - DAY).days + 1): r.sue for r in MO.fresh_at(first, ends, "sue", "q", 10).collect()}
    assert got == {("a", 10): 0.5, ("a", 20): 0.7, ("b", 10): 0.1, ("d", 10): 8.0}


def test_keyed_studies_equal_single_ones_and_hand_costs(spark):
    cal = series(spark, [0.0] * 6).select("session", "pos")
    ends = spark.createDataFrame([(1, DAY, 1, 3), (2, DAY + dt.timedelta(days=2), 3, 5), (3, DAY + dt.timedelta(days=4), 5, None)], "k int, session date, pos int, next_pos int")
    market = spark.createDataFrame([(s, p, r, 1e8) for s, r in (("a", 0.1), ("b", -0.1)) for p in range(1, 7)], "symbol string, pos int, ret double, adv20 double")
    picks = [("x", "a", DAY, 2), ("x", "b", DAY, 2), ("x", "a", DAY + dt.timedelta(days=2), 1), ("y", "b", DAY + dt.timedelta(days=2), 1)]
    selected = spark.createDataFrame(picks, "study string, symbol string, session date, names long")
    keyed = {(r.study, r.pos): (r.gross, r.cost, r.net) for r in MO.study(selected, ends, market, cal, by=("study",)).collect()}
    for name in "xy":
        one = {(name, r.pos): (r.gross, r.cost, r.net) for r in MO.study(selected.where(F.col("study") == name).drop("study"), ends, market, cal).collect()}
        assert one == {k: v for k, v in keyed.items() if k[0] == name}
    flip = lambda w: w * (1.5 + 1.0 + 10.0 * np.sqrt(w * 1e5 / 1e8) + 1.0) / 1e4
    assert keyed["x", 1][1] == pytest.approx(2 * flip(0.5)) and keyed["x", 1][0] is None  # two enter
    assert keyed["x", 3][1] == pytest.approx(flip(0.5)) and keyed["x", 5][1] == pytest.approx(flip(1.0))  # b leaves, then a
    assert keyed["x", 2][0] == pytest.approx(0.0) and keyed["x", 3][0] == pytest.approx((1.1 * 0.1 - 0.9 * 0.1) / 2)
    assert keyed["y", 4] == pytest.approx((-0.1, 0.0, -0.1)) and ("y", 1) not in keyed
