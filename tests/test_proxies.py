"""Signals, trials and decisions of proxies against pandas and hand values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import proxies as PX

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=330)]


@pytest.fixture(scope="module")
def market():
    rng = np.random.default_rng(11)
    rows = []
    for k, s in enumerate("ABC"):
        for i, d in enumerate(DAYS):
            if (i * 7 + k) % 29:  # each symbol misses some sessions
                px = 50 + 10 * k + 8 * np.sin(i / 17 + k) + rng.standard_normal()
                rows.append((s, d, i + 1, float(px), float(px * (1 + rng.standard_normal() * 0.01))))
    return pd.DataFrame(rows, columns=["symbol", "session", "pos", "px", "open_adj"])


@pytest.fixture(scope="module")
def known():
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"session": DAYS})
    for n in PX.SERIES:
        x[n] = 100 + np.cumsum(rng.standard_normal(len(DAYS)))
    x.loc[:20, "ovx"] = np.nan
    x["crude"] = np.repeat(x["crude"].to_numpy()[::5], 5)[: len(x)]
    return x


def spark_frames(spark, market, known):
    bars = spark.createDataFrame(list(market.itertuples(index=False, name=None)), "symbol string, session date, pos int, px double, open_adj double")
    rows = [(r[0], *[None if v != v else float(v) for v in r[1:]]) for r in known.itertuples(index=False, name=None)]
    refs = spark.createDataFrame(rows, "session date, " + ", ".join(f"{n} double" for n in PX.SERIES))
    peers = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "symbol string, peer string")
    return bars, peers, refs


def expected(market, known, symbol, peers):
    p = market[market.symbol == symbol].set_index("session")
    k = known.set_index("session").reindex(p.index)
    px, change = p.px, lambda s, n: s.pct_change(n, fill_method=None)
    energy = pd.Series(bool(peers), index=p.index)
    for q in peers:
        energy &= change(market[market.symbol == q].set_index("session").px.reindex(p.index), 5) > 0
    f = pd.DataFrame({f"trend_{n}": px > px.rolling(n, min_periods=n).mean() for n in (20, 60, 200)})
    for n in (5, 20, 60):
        f[f"momentum_{n}"] = change(px, n) > 0
    f["reversal_1"], f["reversal_5"] = change(px, 1) < 0, change(px, 5) < 0
    f["brent_wti_relative_20"] = (change(k.brent, 20) > change(k.wti, 20)) & (k.wti > 0) & (k.brent > 0)
    f["energy_equity_confirmation_5"] = energy
    f["ovx_below_expanding_p90"] = k.ovx < k.ovx.shift(1).expanding(min_periods=252).quantile(0.9)
    f["dollar_down_20"] = change(k.dollar, 20) < 0
    f["eia_crude_draw"], f["eia_cushing_draw"], f["cftc_managed_money_rising"] = k.crude.diff() < 0, k.cushing.diff() < 0, k.managed.diff() > 0
    f["weekday_tuesday"] = [d.weekday() == 1 for d in p.index]
    f["composite_trend_confirmation"] = f.trend_60 & energy
    f["composite_full"] = f.momentum_20 & f.brent_wti_relative_20 & energy & f.ovx_below_expanding_p90 & f.dollar_down_20
    return p, f[list(PX.SIGNALS)]


def test_signals_and_trials(spark, market, known):
    frame = PX.signal_frame(*spark_frames(spark, market, known))
    got = frame.select("symbol", "session", *PX.SIGNALS).toPandas()
    trials = PX.proxy_trials(frame).toPandas()
    some = set()
    for symbol, peers in (("A", "BC"), ("B", "C"), ("C", "")):
        p, want = expected(market, known, symbol, peers)
        mine = got[got.symbol == symbol].set_index("session")[list(PX.SIGNALS)].sort_index()
        pd.testing.assert_frame_equal(mine.astype(bool), want.astype(bool), check_names=False, check_freq=False)
        some |= {n for n in PX.SIGNALS if want[n].any()}
        for horizon, k in PX.HORIZONS.items():
            gross = p.px.shift(-k) / p.open_adj.shift(-1) - 1
            t = trials[(trials.symbol == symbol) & (trials.horizon == horizon)]
            for name in PX.SIGNALS:
                rows = t[t.signal == name].sort_values("pos")
                on = gross[want[name]].dropna()
                assert rows.gross.tolist() == pytest.approx(on.tolist())
                assert rows.pos.tolist() == p.pos.shift(-k)[on.index].astype(int).tolist()
                assert rows.net.tolist() == pytest.approx((on - 0.002).tolist())
    assert len(some) >= 16


def test_series_are_used_when_known(spark):
    cal = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS[:6])], "session date, pos int")  # Wed 1 to Wed 8 January
    at = lambda day, hour: dt.datetime(2020, 1, day, hour)  # noqa: E731  UTC; the close is at 21:00
    rows = [("wti", 1.0, at(1, 21)), ("wti", 2.0, at(2, 22)), ("wti", None, at(6, 10)), ("dollar", 7.0, at(7, 20)), ("other", 9.0, at(1, 1))]
    known = PX.known_series(cal, spark.createDataFrame(rows, "series string, value double, available_at timestamp")).orderBy("session").collect()
    assert [r.wti for r in known] == [1.0, 1.0, 2.0, 2.0, 2.0, 2.0]
    assert [r.dollar for r in known] == [None, None, None, None, 7.0, 7.0]
    assert all(r.ovx is None for r in known)


def test_empty_market(spark, market, known):
    bars, peers, refs = spark_frames(spark, market, known)
    frame = PX.signal_frame(bars.limit(0), peers, refs)
    assert frame.count() == 0 and PX.proxy_trials(frame).count() == 0


VOTES = "symbol string, session date, five double, trend_vote boolean, momentum_vote boolean, dollar_vote boolean, volatile boolean, ovx double, dollar double, ready long, gap_atr double"
DAY = dt.date(2020, 3, 2)


def decided(spark, rows, frozen=False):
    names = ["symbol", "session", "five", "trend_vote", "momentum_vote", "dollar_vote", "volatile", "ovx", "dollar"]
    votes = spark.createDataFrame(rows, VOTES)
    groups = votes.select(F.lit("G").alias("group"), "symbol").unionByName(spark.createDataFrame([("H", "none")], "group string, symbol string"))
    x = PX.agreement(votes.select(*names), groups).join(votes.select("symbol", "ready", "gap_atr"), "symbol", "left")
    out = PX.horizon_decisions(x, F.weekday("session").isin(1, 2, 3), frozen)
    return {(r.symbol, r.horizon): r for r in out.collect()}


def test_decisions(spark):
    good = lambda s, five=0.1, day=DAY, ovx=20.0, vol=False, ready=2, gap=0.1, trend=True: (s, day, five, trend, True, True, vol, ovx, 90.0, ready, gap)
    d = decided(spark, [good(s) for s in "abcd"])
    assert {(r.agreement, r.votes, r.vetoes, r.status) for k, r in d.items() if k[0] != "none"} == {("BULLISH", 4, "", "WATCH")}
    assert d["none", "INTRADAY"].agreement == "DATA_UNAVAILABLE" and d["none", "INTRADAY"].status == "NO_TRADE"
    assert decided(spark, [good(s) for s in "abcd"], True)["a", "SWING_3D"].status == "PAPER_LONG"
    d = decided(spark, [good("a"), good("b", -0.1), good("c", -0.1), good("d")])
    assert d["a", "INTRADAY"].agreement == "MIXED" and d["a", "INTRADAY"].votes == 3 and d["a", "INTRADAY"].vetoes == "PROXY_AGREEMENT"
    d = decided(spark, [good("a"), good("b", -0.1, trend=False), good("c", -0.1), good("d", -0.1)])
    assert d["a", "INTRADAY"].agreement == "BEARISH" and d["b", "INTRADAY"].vetoes == "PROXY_AGREEMENT,COMPOSITE_ABSENT"
    later = DAY + dt.timedelta(days=1)  # Tuesday: three sessions after Wednesday is Monday
    d = decided(spark, [good(s, day=later) for s in "abcd"])
    assert d["a", "INTRADAY"].vetoes == "" and d["a", "SWING_3D"].vetoes == "CROSSES_WEEKEND"
    d = decided(spark, [good("a", vol=True, ready=0, gap=1.6), good("b", ovx=None), good("c"), good("d", day=later)])
    assert d["a", "INTRADAY"].vetoes == "PROXY_BARS,NO_LANE,ENTRY_GAP,VOLATILITY_HIGH"
    assert d["b", "INTRADAY"].vetoes == "PROXY_BARS,REFERENCES"
