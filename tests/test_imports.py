"""Records with two clocks, page layouts and pinned sets, by hand values and brute force."""

import datetime as dt
import random


from chronopanel.operators import bitemporal as BT
from chronopanel.sources import landed as L
from chronopanel.sources import pages as PG

D = dt.date


def test_a_late_old_revision_does_not_replace_a_newer_one(spark):
    rng = random.Random(3)
    day = lambda k: D(2020, 1, 1) + dt.timedelta(days=k)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(6)}", rng.randrange(400), i, float(i)) for i in range(500)]
    rows = [(k, day(v), day(v + rng.choice([0, 1, 5, 90])), r, x) for k, v, r, x in rows]
    asked = [(k, day(m)) for k in ("hot", "k1", "k5", "absent") for m in range(0, 520, 13)]
    got = BT.known_at(spark.createDataFrame(asked, "id string, m date"), spark.createDataFrame(rows, "id string, v date, a date, r int, x double"), ["id"], "m", ["v", "r"], "a", ["r", "x", "v"]).collect()
    assert len(got) == len(asked)
    for g in got:
        there = [(v, r, x) for k, v, a, r, x in rows if k == g.id and a <= g.m]
        assert (g.v, g.r, g.x) == (max(there) if there else (None, None, None))


def test_import_gates(spark):
    rows = [("a", 1, D(2020, 1, 2), D(2020, 1, 3), D(2020, 1, 3)), ("a", 1, D(2020, 1, 2), D(2020, 1, 1), D(2020, 1, 5)), ("a", 2, D(2020, 1, 2), D(2020, 1, 4), D(2020, 1, 3)), (None, 3, D(2020, 1, 2), D(2020, 1, 3), D(2020, 1, 3))]
    got = {r.gate: (r.n_rows, r.n_faults, r.status) for r in BT.vintage_faults(spark.createDataFrame(rows, "id string, rev int, e date, k date, f date"), ["id", "rev"], "e", "k", "f").collect()}
    assert got == {"DUPLICATE_REVISION": (4, 1, "BLOCK"), "KNOWN_BEFORE_EVENT": (4, 1, "BLOCK"), "FETCHED_BEFORE_KNOWN": (4, 1, "BLOCK"), "MISSING_VALUE": (4, 1, "BLOCK")}


def test_ticker_holds_only_inside_its_interval_and_once_known(spark):
    t = spark.createDataFrame([("s", D(2020, 1, 10), D(2020, 2, 1), D(2020, 1, 12), "A"), ("s", D(2020, 3, 1), None, D(2020, 2, 20), "B")], "id string, start date, end date, known date, ticker string")
    days = [D(2020, 1, 9), D(2020, 1, 10), D(2020, 1, 12), D(2020, 1, 31), D(2020, 2, 1), D(2020, 2, 25), D(2020, 3, 1), D(2021, 1, 1)]
    rows = spark.createDataFrame([("s", d) for d in days] + [("none", days[0])], "id string, d date")
    got = {(r.id, r.d): r.ticker for r in BT.valid_at(rows, t, ["id"], "d", ["ticker"]).collect()}
    assert [got["s", d] for d in days] == [None, None, "A", "A", None, None, "B", "B"] and got["none", days[0]] is None


def test_both_meeting_layouts(spark):
    boxes = """<h4>2021 FOMC Meetings</h4><div class="fomc month"><strong>January</strong></div><div class="fomc date">26-27* <a href="/a.htm">x</a></div>
      <div class="month">Apr/May</div><div class="date">30-1</div><div class="month">March</div><div class="date">3 (unscheduled)</div>
      <h4>2020 FOMC Meetings</h4><div class="month">December/January</div><div class="date">31-1</div><div class="date">30 (notation vote)</div><div class="month">June</div><div class="date">tbd</div>
      <div class="month">February</div><div class="date">30-31</div>"""
    headings = "<h5>January 29-30 Meeting - 2019</h5><p>October 1-2 Meeting</p><h5>October 7 Conference Call - 2008</h5><h5>January 29-30 Meeting - 2019</h5><h5>Minutes 2019</h5>"
    early = "<div class='month'>May</div><div class='date'>1-2</div>"  # no year yet
    pages = spark.createDataFrame([(1, boxes), (2, headings), (3, early), (4, None), (5, "")], "page_id long, html string")
    got = sorted(tuple(r) for r in PG.meetings(PG.page_items(pages)).collect())
    assert got == [
        (1, D(2020, 12, 30), D(2020, 12, 30), None, False), (1, D(2020, 12, 31), D(2021, 1, 1), None, True), (1, D(2021, 1, 26), D(2021, 1, 27), "/a.htm", True), (1, D(2021, 3, 3), D(2021, 3, 3), None, False), (1, D(2021, 4, 30), D(2021, 5, 1), None, True),
        (2, D(2008, 10, 7), D(2008, 10, 7), None, False), (2, D(2019, 1, 29), D(2019, 1, 30), None, True),
    ]


def test_spanned_cells_stand_in_each_row(spark):
    html = """<table id="constituents"><tr><th>Symbol</th><th>N</th><th>S</th><th>I</th></tr>
      <tr><td>brk.b</td><td>One</td><td rowspan="3">Tech</td><td>x</td><td>y</td><td rowspan="2">2001-05-06</td><td>0001</td></tr>
      <tr><td>AA</td><td>Two</td><td>z</td><td></td><td>77</td></tr><tr><td>CC</td><td>Three</td><td></td></tr><tr><td>DD</td><td>Four</td></tr></table>"""
    got = sorted(tuple(r)[1:] for r in PG.constituents(PG.table_grid(spark.createDataFrame([(1, html)], "page_id long, html string"))).collect())
    assert got == [("AA", "Two", "Tech", "z", D(2001, 5, 6), "77"), ("BRK-B", "One", "Tech", "x", D(2001, 5, 6), "0001"), ("CC", "Three", "Tech", "Unknown", None, "")]


def test_digest_of_a_set_ignores_names_and_order(spark, tmp_path):
    for folder, names in (("one", ("a", "b")), ("two", ("y", "x")), ("three", ("a", "b"))):
        (tmp_path / folder / "p=1").mkdir(parents=True)
        for name, body in zip(names, (b"first", b"second" if folder != "three" else b"other")):
            (tmp_path / folder / "p=1" / name).write_bytes(body)
    digest = lambda f: L.set_digests(L.file_hashes(spark, str(tmp_path / f)), "partition").first()
    one, two, three = digest("one"), digest("two"), digest("three")
    assert one.partition == "p=1" and one.n_files == 2 and one.digest == two.digest != three.digest
    pins = spark.createDataFrame([("p=1", one.digest)], "partition string, expected string")
    assert [L.pinned_partitions(spark, str(tmp_path / f), pins).first().matches for f in ("two", "three")] == [True, False]
