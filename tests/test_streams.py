"""Streams give the batch answer whatever number of files a folder holds."""

import os

import pytest
from pyspark.sql import functions as F

from chronopanel.plans import load
from chronopanel.streaming import runs as RN

QUERIES = "captured_signals marks_stream state_machine streamed_minute_bars fresh_quote_pairs inserted_runs".split()


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    """The events as one file and as 40 shuffled files, the other tables linked beside them."""
    out = []
    for n in (1, 40):
        folder = tmp_path_factory.mktemp(f"files{n}")
        for name in os.listdir(sf):
            if name != "events.parquet":
                os.symlink(f"{sf}/{name}", folder / name)
        spark.read.parquet(f"{sf}/events.parquet").repartition(n, F.col("event_id") % n).write.parquet(f"{folder}/events.parquet")
        out.append(str(folder))
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_one_file_or_forty(spark, folders, name):
    from check import canonical, duck

    con = duck(folders[0].rstrip("/")) if os.path.isfile(f"{folders[0]}/events.parquet") else None
    if con is None:
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folders[0]}/events.parquet/*.parquet')")
    want = canonical(con.execute(load()[name].sql).fetchdf())
    assert want
    for folder in folders:
        assert canonical(load()[name].run(spark, folder).toPandas()) == want, folder


def test_dropped_rows_fail_the_job(spark, folders):
    bars = RN.minute_bars(RN.tick_stream(spark, folders[1], files_per_batch=1), "0 seconds")
    with pytest.raises(RN.LateRows):
        RN.drain_updates(bars, "late-bars", ["symbol", "ts"])


def test_a_stored_run_is_not_written_again(spark, tmp_path):
    schema = "run string, leverage double, horizon int, item int"
    allowed = {"leverage": (1.0, 1.5, 2.0), "horizon": (21, 252)}

    def insert(rows, folder):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{folder}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{folder}")
        return sorted(map(tuple, RN.insert_new_runs(stream, "run", ["leverage", "horizon"], allowed, "runs", f"{tmp_path}/sink").collect()))

    first = [("a", 1.0, 21, 1), ("a", 1.0, 21, 2), ("b", 3.0, 21, 1), ("c", 1.0, 21, 1), ("c", 2.0, 21, 2)]
    assert insert(first, "one") == first[:2]
    # a sink that holds the run under another batch refuses it
    os.rename(f"{tmp_path}/sink/batch=0", f"{tmp_path}/sink/batch=77")
    assert insert([("a", 1.0, 21, 3), ("d", 1.5, 252, 1)], "two") == [*first[:2], ("d", 1.5, 252, 1)]


def test_ordered_replay_keeps_rows_without_an_order(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from chronopanel.streaming import runs

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("event_id", F.when(F.col("event_id") % 10 > 0, F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    out = runs.drain_in_order(spark, str(tmp_path), lambda t: t.select("event_id"), "nulls")
    assert out.count() == events.count() and out.where("event_id is null").count() > 0


def test_a_replay_folds_keys_of_any_size(spark):
    """A key over many Arrow batches beside small ones, in two batches, as a plain loop over each key has it."""
    from chronopanel.streaming import stateful as ST

    words = ["WAITING", "CONFIRMED", "UPDATED", "CANCELLED", "ENTERED", "EXITED"]
    rows = [("hot" if i % 2 else f"k{i % 50}", i, words[i * 7 % 11 % 6], i % 2 if i % 3 == 0 else None) for i in range(6000)]
    want, now = set(), {}
    for key, i, to, expected in rows:
        state, revision = now.get(key, ("PROPOSED", 0))
        moved = to in ST.ALLOWED.get(state, ()) and expected in (None, revision)
        now[key] = (to, revision + 1) if moved else (state, revision)
        want.add((key, i, to, moved, *now[key]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got, before = set(), None
        for part in (rows[:2500], rows[2500:]):
            batch = spark.createDataFrame(part[::-1], "recommendation_id string, event_id bigint, to_state string, expected int")
            out = ST.folded(batch, before, ST.CHANGES).cache()
            got |= {tuple(r)[:6] for r in out.where("not held").collect()}
            before = out.where("held")
        assert got == want
        assert {(r[0], r["now_state"], r["now_revision"]) for r in before.collect()} == {(k, *v) for k, v in now.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks_fold_keeps_extremes_of_accepted_prices_over_batches(spark):
    """A late mark, a mark without a price and one of the same moment, dealt over two batches."""
    import datetime as dt

    from chronopanel.streaming import stateful as ST

    at = lambda m: dt.datetime(2024, 1, 2, 10, m)
    rows = [("a", 1, at(5), 3.0, 1), ("a", 2, at(4), 9.0, 2), ("a", 3, at(6), None, 3), ("a", 4, at(6), 8.0, 4), ("a", 5, at(7), 1.0, 5), ("b", 6, at(1), None, 6), ("b", 7, at(2), 2.0, 7)]
    want = {("a", 1, True, 3.0, 3.0), ("a", 2, False, 3.0, 3.0), ("a", 3, True, 3.0, 3.0), ("a", 4, False, 3.0, 3.0), ("a", 5, True, 1.0, 3.0), ("b", 6, True, None, None), ("b", 7, True, 2.0, 2.0)}
    got, before = set(), None
    for part in (rows[:4], rows[4:]):
        batch = spark.createDataFrame(part, "recommendation_id string, event_id bigint, at timestamp, price double, arrival bigint")
        out = ST.folded(batch, before, ST.MARKS).cache()
        got |= {tuple(r)[:5] for r in out.where("not held").collect()}
        before = out.where("held")
    assert got == want
