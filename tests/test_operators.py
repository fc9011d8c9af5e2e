"""As-of joins, intervals, frames, recursion, quality and ledgers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.functions import clock
from chronopanel.operators import calendar as C
from chronopanel.operators import crosssec as X
from chronopanel.operators import features as FE
from chronopanel.operators import membership as M
from chronopanel.operators import paper as PA
from chronopanel.operators import quality as Q
from chronopanel.operators import reconcile as R
from chronopanel.operators import recursive as REC
from chronopanel.operators import validation as V
from chronopanel.operators.asof import asof_join
from chronopanel.operators.clusters import components
from chronopanel.operators.portfolio import fill_limited
from chronopanel.sources import panel as P


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_matches_pandas_with_a_hot_key(spark, direction, strict):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-01-01")

    def frame(n, name):
        keys = np.where(rng.uniform(size=n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
        secs = rng.choice(np.arange(0, 10 * 86400, 977), n, replace=False)
        return pd.DataFrame({"k": keys, "t": base + pd.to_timedelta(secs, unit="s"), name: np.arange(n, dtype=float)})

    left, right = frame(300, "id"), frame(200, "v")
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "t", ["v"], direction, strict, bucket_seconds=7200)
    got = got.toPandas().set_index("id")["v"].sort_index()
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("t"), on="t", by="k", direction=direction, allow_exact_matches=not strict)
    want = want.set_index("id")["v"].sort_index()
    assert len(got) == len(left) and np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_asof_tolerance(spark):
    left = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 12))], "k string, t timestamp")
    right = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 1.0)], "k string, t timestamp, v double")
    assert asof_join(left, right, ["k"], "t", "t", ["v"], tolerance=3600).first()["v"] is None
    assert asof_join(left, right, ["k"], "t", "t", ["v"], tolerance=7200).first()["v"] == 1.0


def test_new_york_close_in_both_seasons(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 7, 5),)], "d date")
    got = [r[0] for r in df.select(clock.stamp(clock.bar_available("d"))).collect()]
    assert got == ["2024-01-05 21:15:00", "2024-07-05 20:15:00"]


def test_percent_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 2.0), ("d", 1, None)], "symbol string, session int, v double")
    got = {r["symbol"]: r["p"] for r in df.withColumn("p", X.percent_rank_average("v")).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(2.5 / 3), "c": pytest.approx(2.5 / 3), "d": None}


def test_five_lowest_moves_are_selected(spark):
    moves = {"AAA": -0.30, "BBB": -0.25, "CCC": -0.20, "DDD": -0.15, "EEE": -0.10, "FFF": -0.05} | {f"Z{i}": 0.01 for i in range(10)}
    df = spark.createDataFrame([(k, 1, -v) for k, v in moves.items()], "symbol string, session int, rev double")
    got = {r["symbol"] for r in X.top_k_entries(df, "rev", (5,)).where("side = 'LONG'").collect()}
    assert got == {"AAA", "BBB", "CCC", "DDD", "EEE"}


def test_frames_skip_missing_sessions(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 4.0)], "symbol string, pos int, px double")
    got = {r["pos"]: r["m"] for r in df.withColumn("m", FE.reversal(1)).collect()}
    assert got == {1: None, 2: pytest.approx(-1.0), 4: None}


def test_features_ignore_the_future_and_a_leak_is_found(spark, sf):
    base = P.placed(spark, sf)
    causal = lambda d: d.select("symbol", "session", FE.reversal(5).alias("f"))
    leaky = lambda d: d.select("symbol", "session", F.lead("px").over(W.partitionBy("symbol").orderBy("session")).alias("f"))
    assert V.prefix_breaks(causal, base, "1998-06-01").count() == 0
    assert V.prefix_breaks(leaky, base, "1998-06-01").count() > 0


def test_averages_equal_their_weighted_sums(spark, sf):
    got = REC.indicators(P.placed(spark, sf)).toPandas()
    px = P.placed(spark, sf).select("symbol", "session", "px").toPandas().sort_values("session")
    for symbol, rows in px.groupby("symbol"):
        x, a = rows["px"].to_numpy(), 2.0 / 21
        weights = np.r_[(1 - a) ** (len(x) - 1), a * (1 - a) ** np.arange(len(x) - 2, -1, -1)]
        last = got[got["symbol"] == symbol].sort_values("session")["ema20"].iloc[-1]
        assert last == pytest.approx(float(weights @ x))


def test_turn_of_month_is_seen_from_the_next_session(spark):
    days = pd.bdate_range("2024-01-29", "2024-02-08")
    cal = P.number_sessions(spark.createDataFrame([(d.date(),) for d in days], "session date"))
    got = [str(r["session"]) for r in C.observed_turn_of_month(cal).where("tom").orderBy("session").collect()]
    assert got == ["2024-01-31", "2024-02-01", "2024-02-02", "2024-02-05"]


def test_episode_dates(spark):
    from chronopanel.operators.episodes import episodes, plan

    days = pd.bdate_range("2023-12-29", "2024-02-29")
    px = 1.001 ** np.arange(len(days)) * 100
    rows = [("S", d.date(), float(p), float(p), 1e6) for d, p in zip(days, px)]
    bars = spark.createDataFrame(rows, "symbol string, session date, close double, adjusted_close double, volume double")
    e = episodes(bars, plan(P.number_sessions(bars))).where("month = '2024-01-01'").first()
    assert (str(e["entry"]), str(e["exit"])) == ("2024-01-30", "2024-02-05") and e["gross"] == pytest.approx(1.001**4 - 1)


def test_overlapping_and_inverted_intervals_are_faults(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2020, 1, 1), d(2021, 1, 1)), ("a", d(2020, 6, 1), d(2022, 1, 1)), ("b", d(2020, 1, 1), None), ("b", d(2021, 1, 1), None),
                                ("c", d(2020, 1, 1), d(2019, 1, 1)), ("e", d(2020, 1, 1), d(2021, 1, 1)), ("e", d(2021, 1, 1), None)], "symbol string, start date, end date")
    got = {(r["symbol"], r["fault"]) for r in M.interval_faults(df).collect()}
    assert got == {("a", "OVERLAP"), ("b", "AFTER_OPEN"), ("c", "INVERTED")}


def test_bar_gate_counts_every_rule(spark):
    t = dt.datetime(2024, 1, 2, 21)
    rows = [("a", dt.date(2024, 1, 2), t, t, 1.0, 2.0, 0.5, 1.5, 10.0), ("a", dt.date(2024, 1, 2), t, t + dt.timedelta(minutes=15), 1.0, 0.9, 0.5, 1.5, -1.0)]
    df = spark.createDataFrame(rows, "symbol string, session date, event_time timestamp, available_at timestamp, open double, high double, low double, close double, volume double")
    r = Q.bar_gate(df).first()
    assert (r["availability"], r["range"], r["volume"], r["duplicates"]) == (1, 1, 1, 1)


def test_table_digest_ignores_partitioning(spark, sf):
    b = P.bars(spark, sf)
    assert Q.table_digest(b).first() == Q.table_digest(b.repartition(7, "session")).first()


@pytest.mark.parametrize("after,want", [(50.0, "RAW"), (100.0, "SPLIT_ADJUSTED")])
def test_split_votes(spark, after, want):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(8)]
    a, b, pa, pb = [], [], 100.0, 100.0
    for i, d in enumerate(days):
        split = 2.0 if i % 2 else 1.0
        if i % 2:
            pa, pb = pa * after / 100.0, pb / 2.0
        a.append(("s", d, pa))
        b.append(("s", d, pb, pb, 0.0, split))
    fa = spark.createDataFrame(a, "symbol string, session date, close double")
    fb = spark.createDataFrame(b, "symbol string, session date, close double, adjusted_close double, dividend double, split_factor double")
    r = R.action_votes(R.paired(fa, fb)).first()
    assert (r["convention"], r["verdict"]) == (want, "CONFIRMED")


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 2)], "node string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    got = {r["node"]: r["label"] for r in components(nodes, edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(n)} == {"n000"} and got[f"n{n:03d}"] == f"n{n:03d}"


def test_locked_names_keep_their_position_and_the_cap_holds(spark):
    rows = [("t", s, p, d, ok) for p, a, b, oa, ob in [(1, 0.0, 0.0, True, True), (2, 0.3, 0.3, False, True), (3, 0.0, 0.6, True, True)] for s, d, ok in (("a", a, oa), ("b", b, ob))]
    df = spark.createDataFrame(rows, "trial string, symbol string, pos int, desired double, tradable boolean")
    got = {(r["symbol"], r["pos"]): r["weight"] for r in fill_limited(df, 0.5).collect()}
    assert got[("a", 2)] == pytest.approx(0.25) and got[("a", 3)] == pytest.approx(0.25) and got[("b", 3)] == pytest.approx(0.25)


def test_retroactive_marks_are_refused(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("r", 1, t(1), 10.0, "1"), ("r", 2, t(3), 12.0, "2"), ("r", 3, t(2), 5.0, "3"), ("r", 4, t(4), 9.0, "4")],
                               "recommendation_id string, event_id bigint, at timestamp, price double, arrival string")
    got = {r["event_id"]: (r["accepted"], r["low"]) for r in PA.accepted_marks(df).collect()}
    assert got == {1: (True, 10.0), 2: (True, 10.0), 3: (False, 10.0), 4: (True, 9.0)}


def test_winsorised_path_uses_only_the_past(spark):
    rng = np.random.default_rng(0)
    px = list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 60))))
    px[40] *= 3
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(px)]
    full = REC.causal_winsorize(spark.createDataFrame(rows, "symbol string, session date, px double")).orderBy("session").toPandas()
    head = REC.causal_winsorize(spark.createDataFrame(rows[:45], "symbol string, session date, px double")).orderBy("session").toPandas()
    assert full["corrected"].sum() >= 1 and np.allclose(full["fixed"][:45], head["fixed"])
    assert full["fixed"][40] < px[40]


@pytest.fixture(scope="module")
def zero_fills(spark, tmp_path_factory):
    """Events of four recommendations: filled at zero and left above, below or at zero, and one filled at a price."""
    folder = str(tmp_path_factory.mktemp("zero-fills"))
    rows, kinds = [], ("view", "click", "purchase")
    for user, prices in enumerate([(0.0, 3.0, 5.0), (0.0, 0.0, 0.0), (0.0, -2.0, -1.0), (4.0, 0.0, 5.0), (0.0, 1.0, None)]):
        rows += [(10 * user + i, dt.datetime(2024, 1, 2, 10, i), user, k, p, "{}") for i, (k, p) in enumerate(zip(kinds, prices, strict=True)) if p is not None]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def as_its_sql(spark, folder, name):
    import duckdb
    from check import canonical

    from chronopanel.plans import load

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got, want = canonical(load()[name].run(spark, folder).toPandas()), canonical(con.execute(load()[name].sql).fetchdf())
    assert want and got == want


def test_a_fill_at_zero_has_an_infinite_return(spark, zero_fills):
    as_its_sql(spark, zero_fills, "fills_with_exits")


def test_outcomes_of_fills_at_zero(spark, zero_fills):
    as_its_sql(spark, zero_fills, "immutable_outcomes")


def test_a_scorecard_counts_wins_by_prices(spark, zero_fills):
    as_its_sql(spark, zero_fills, "ledger_scorecard")


def test_moves_from_an_entry_at_zero(spark, zero_fills):
    as_its_sql(spark, zero_fills, "running_excursions")


@pytest.mark.parametrize("name", ["immutable_outcomes", "fills_with_exits", "running_excursions"])
def test_any_event_number_breaks_ties(spark, tmp_path, name):
    """Events numbered past 10^15 and below zero; two of one instant differ by their numbers only."""
    rows = []
    for user, first in enumerate((2 * 10**15, 2**63 - 10, -(2**63), -(10**15))):
        for i, (k, p, minute) in enumerate([("view", 4.0, 0), ("view", 5.0, 0), ("click", 3.0, 1), ("purchase", 6.0, 2), ("purchase", 8.0, 2)]):
            rows.append((first + i, dt.datetime(2024, 1, 2, 10, minute), user, k, p, "{}"))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    as_its_sql(spark, str(tmp_path), name)
