"""Landed folders under a contract: read with filters, followed as a stream, and held against their rules."""

import datetime as dt

from chronopanel.sources import contracts as SC

C = SC.CONTRACTS["events"]


def rows(spark, ids):
    at = dt.datetime(2020, 1, 2, 9, 30)
    return spark.createDataFrame([(i, f"S{i % 3}", "HALT" if i % 2 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i), at + dt.timedelta(days=i)) for i in ids], C.schema)


def test_filters_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = rows(spark, range(40)).repartition(4)
    SC.land(df, C, folder)
    read = SC.read(spark, C, folder)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()))
    some = read.where("symbol = 'S1' AND event_day >= DATE '2020-01-11' AND event_id < 30")
    assert sorted(r.event_id for r in some.collect()) == [i for i in range(10, 30) if i % 3 == 1]
    reader = SC.LandedReader(C, SC.landed_files(spark, folder))
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("symbol",), "S1"), GreaterThan(("available_at",), dt.datetime(2020, 1, 1)), In(("kind",), ("HALT",))]))
    assert len(left) == 2 and reader.tests == [("symbol", "equal", "S1")]
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 13
    assert len(reader.partitions()) == len(SC.landed_files(spark, folder)) > 1


def test_a_folder_is_followed_file_by_file(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def arrive(name, ids):
        SC.land(rows(spark, ids).coalesce(1), C, str(tmp_path / name))
        (part,) = (tmp_path / name).glob("part-*.csv")
        (tmp_path / "in" / f"{name}.csv").write_bytes(part.read_bytes())

    def run():
        q = SC.follow(spark, C, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.event_id for r in spark.read.schema(C.schema).parquet(out).collect())

    arrive("a", range(5))
    assert run() == list(range(5))
    arrive("b", range(5, 9))
    arrive("c", range(9, 10))
    assert run() == list(range(10))
    assert run() == list(range(10))


def test_rules_of_a_contract(spark):
    df = rows(spark, range(4)).unionByName(rows(spark, [2])).unionByName(spark.createDataFrame([(9, None, "X", dt.date(2021, 1, 1), dt.datetime(2020, 1, 1)), (None, "S", "X", dt.date(2019, 1, 1), dt.datetime(2020, 1, 1))], C.schema))
    assert {r.rule: r.n for r in SC.violations(df, C).collect()} == {"ROWS": 7, "MISSING_VALUE": 1, "REPEATED_KEY": 1, "KNOWN_BEFORE_EVENT": 1}
