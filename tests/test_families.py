"""Declared families: counts, entries of gates and months, positions of unequal holdings."""

import datetime as dt

import pandas as pd

from chronopanel.operators import crossfamilies as CF
from chronopanel.operators import families as FA

FLAGS = ("session date, pos int, weekday int, month int, turn_of_month boolean, pre_holiday boolean, post_holiday boolean, event_day_before boolean, "
         "event_day_of boolean, event_week boolean, opex_week boolean, month_end_window boolean, quarter_end_window boolean")


def flags(spark, n=60):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=n)]
    rows = [(d, i + 1, d.weekday(), d.month, d.day <= 3, False, False, False, False, False, False, False, False) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, FLAGS)


def test_declared_counts(spark):
    n = {r.family: r["count"] for r in FA.declared(spark).groupBy("family").count().collect()}
    assert n == {"CALENDAR": 4236, "REVERSAL": 30, "LOSS_AWARE": 900, "VETO": 10, "OVERNIGHT": 24, "CROSS_SECTIONAL": 16, "COMBINATION": 16}
    assert FA.declared(spark).distinct().count() == sum(n.values())


def test_entries_and_positions(spark):
    names = [f"s{k:02d}" for k in range(20)]
    ranked = [(f, s, p, float(k)) for f in ("momentum_12_1", "reversal_5d", "max_lottery") for p in (1, 24, 25) for k, s in enumerate(names)]
    scores = spark.createDataFrame(ranked, "family string, symbol string, pos int, score double")
    e = CF.family_entries(scores, flags(spark)).toPandas()
    plain = e[e.trial == "reversal_5d|ANY|LONG"]
    assert len(plain) == 12 and (plain.held == 5).all() and set(plain.weight.abs()) == {0.1}  # two names a side, five cohorts
    short = e[e.trial == "reversal_5d|ANY|SHORT"].sort_values(["pos", "symbol"]).weight.tolist()
    assert short == (-plain.sort_values(["pos", "symbol"]).weight).tolist()
    monthly = e[e.trial == "momentum_12_1|ANY|LONG"]  # first sessions: 1 January, 3 February (24), 2 March (44); 25 is none
    assert sorted(set(zip(monthly.pos, monthly.held))) == [(1, 23), (24, 20)] and set(monthly.weight.abs()) == {0.5}
    friday = e[e.trial == "momentum_12_1|weekday=4|LONG"]  # earns first two sessions on: 3 (Friday), 26 (Wednesday), 27
    assert set(friday.pos) == {1}
    assert set(e[e.trial == "reversal_5d|turn_of_month=TOM|LONG"].pos) == {1}
    assert not [t for t in set(e.trial) if t.startswith("max_lottery|") and "|ANY|" not in t]


def test_positions_follow_their_own_holding(spark):
    rows = [("t", "a", 1, 0.5, 3), ("t", "a", 4, -0.5, 1), ("u", "a", 1, 0.2, 2), ("u", "a", 2, 0.2, 2)]
    got = CF.standing_positions(spark.createDataFrame(rows, "trial string, symbol string, pos int, weight double, held int"), lag=1).toPandas()
    at = {(r.trial, r.pos): (round(r.weight, 9), round(r.previous, 9)) for r in got.itertuples()}
    assert at == {("t", 2): (0.5, 0.0), ("t", 3): (0.5, 0.5), ("t", 4): (0.5, 0.5), ("t", 5): (-0.5, 0.5), ("t", 6): (0.0, -0.5),
                  ("u", 2): (0.2, 0.0), ("u", 3): (0.4, 0.2), ("u", 4): (0.2, 0.4), ("u", 5): (0.0, 0.2)}


def test_only_funds_rank_among_funds(spark):
    rows = [(s, kind, dt.date(2020, 1, 1) + dt.timedelta(days=i), i + 1, 10.0 + i, 10.0 + i, 10.0, None, None)
            for s, kind in (("a", "etf"), ("b", "equity")) for i in range(30)]
    r = spark.createDataFrame(rows, "symbol string, asset_type string, session date, pos int, px double, open_adj double, volume double, px1 double, ret double")
    got = {(x.family, x.symbol) for x in CF.scores(r).select("family", "symbol").distinct().collect()}
    assert got == {("reversal_5d", "a"), ("reversal_5d", "b"), ("etf_relative_reversal", "a")}
