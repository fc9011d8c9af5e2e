"""Imports with two clocks, pinned files, and pages read by a carried parse."""

from pyspark.sql import functions as F

from ..operators import bitemporal as BT
from ..session import scratch_path
from ..sources import landed as L
from ..sources import pages as PG
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part

# Every order is one revision of its customer's estimate for the quarter; it arrives up to ten days after it is made,
# so a later revision can be known before an earlier one.
part("vintages", "", """
SELECT o_custkey || '|' || year(o_orderdate) || 'Q' || quarter(o_orderdate) AS estimate_id, o_custkey AS security_id, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, o_totalprice AS value,
 o_orderkey AS revision, CAST(o_orderdate AS DATE) AS event_day, CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7) % 11 AS INTEGER) AS known_day, CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7) % 11 + o_orderkey % 3 - CASE WHEN o_orderkey % 97 = 0 THEN 3 ELSE 0 END AS INTEGER) AS fetched_day
FROM orders""")


def vintages(spark, sf):
    def build():
        day = F.to_date("o_orderdate")
        quarter = F.date_sub(F.add_months(F.trunc(day, "quarter"), 3), 1)
        late = (F.col("o_orderkey") * 7) % 11
        fetched = late + F.col("o_orderkey") % 3 - F.when(F.col("o_orderkey") % 97 == 0, 3).otherwise(0)
        name = F.concat(F.col("o_custkey").cast("string"), F.lit("|"), F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
        return P.table(spark, sf, "orders").select(
            name.alias("estimate_id"), F.col("o_custkey").alias("security_id"), quarter.alias("period_end"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("revision"),
            day.alias("event_day"), F.date_add(day, late.cast("int")).alias("known_day"), F.date_add(day, fetched.cast("int")).alias("fetched_day"))

    return P.kept(spark, sf, "vintages", build)


@query("SRC-22 FLT-02", "estimate_id moment #revision ~value event_day", parts="vintages", sql="""
WITH m AS (SELECT DISTINCT estimate_id, period_end - CAST(d AS INTEGER) AS moment FROM vintages CROSS JOIN (VALUES (60),(30),(5),(0)) t(d))
SELECT m.estimate_id, m.moment, max(v.revision) AS revision, max(v.value) AS value, max(v.event_day) AS event_day FROM m LEFT JOIN (SELECT m.estimate_id, m.moment, max_by(v, (v.event_day, v.revision)) AS v FROM m JOIN vintages v ON v.estimate_id = m.estimate_id AND v.known_day <= m.moment GROUP BY ALL) b ON b.estimate_id = m.estimate_id AND b.moment = m.moment GROUP BY ALL""".replace("max(v.revision)", "any_value(b.v.revision)").replace("max(v.value)", "any_value(b.v.value)").replace("max(v.event_day)", "any_value(b.v.event_day)"))
def estimates_as_known(spark, sf):
    """The newest revision of each estimate that had arrived at four moments before the end of its period."""
    v = vintages(spark, sf)
    moments = F.explode(F.array(*[F.date_sub("period_end", d) for d in (60, 30, 5, 0)])).alias("moment")
    asked = v.select("estimate_id", moments).distinct()
    return BT.known_at(asked, v, ["estimate_id"], "moment", ["event_day", "revision"], "known_day", ["revision", "value", "event_day"])


@query("SRC-22 FLT-17", "gate #n_rows #n_faults status", parts="vintages", sql="""
WITH c AS (SELECT count(*) AS n, count(*) FILTER (known_day < event_day) AS a, count(*) FILTER (fetched_day < known_day) AS b, count(*) FILTER (estimate_id IS NULL OR revision IS NULL OR event_day IS NULL OR known_day IS NULL OR fetched_day IS NULL) AS m, (SELECT count(*) FROM (SELECT estimate_id, revision FROM vintages GROUP BY ALL HAVING count(*) > 1)) AS d FROM vintages)
SELECT gate, n AS n_rows, k AS n_faults, CASE WHEN k = 0 THEN 'PASS' ELSE 'BLOCK' END AS status FROM (SELECT 'DUPLICATE_REVISION' AS gate, n, d AS k FROM c UNION ALL SELECT 'KNOWN_BEFORE_EVENT', n, a FROM c UNION ALL SELECT 'FETCHED_BEFORE_KNOWN', n, b FROM c UNION ALL SELECT 'MISSING_VALUE', n, m FROM c)""")
def estimate_gates(spark, sf):
    return BT.vintage_faults(vintages(spark, sf), ["estimate_id", "revision"], "event_day", "known_day", "fetched_day")


@query("SRC-22", "symbol session ticker", parts="bars members", sql="""
WITH t AS (SELECT symbol, start, "end", start + 3 AS known, replace(symbol, 'NATION_', 'N') || CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY start) = 1 THEN '.A' ELSE '.B' END AS ticker FROM members)
SELECT b.symbol, b.session, t.ticker FROM bars b LEFT JOIN t ON t.symbol = b.symbol AND b.session >= t.start AND (t."end" IS NULL OR b.session < t."end") AND t.known <= b.session""")
def ticker_at_session(spark, sf):
    """The ticker of each bar's security on its session, as far as it was known by then."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("symbol").orderBy("start"))
    ticker = F.concat(F.replace("symbol", F.lit("NATION_"), F.lit("N")), F.when(n == 1, ".A").otherwise(".B"))
    t = P.memberships(spark, sf).select("symbol", "start", "end", F.date_add("start", 3).alias("known"), ticker.alias("ticker"))
    return BT.valid_at(P.bars(spark, sf).select("symbol", "session"), t, ["symbol"], "session", ["ticker"])


LINE = "strftime(session, '%Y-%m-%d') || ',' || CAST(round(close*100) AS BIGINT)"
part("landed_pins", "bars", f"""
SELECT symbol, count(*) AS n, sha256(string_agg({LINE}, chr(10) ORDER BY session) || chr(10)) AS content,
 sha256(string_agg({LINE}, chr(10) ORDER BY session) FILTER (asset_type <> 'etf' OR session < (SELECT max(session) FROM bars)) || chr(10)) AS pinned FROM bars GROUP BY symbol""")


def lines(spark, sf):
    line = F.concat_ws(",", F.date_format("session", "yyyy-MM-dd"), F.round(F.col("close") * 100).cast("bigint").cast("string"))
    return P.bars(spark, sf).select("symbol", "session", "asset_type", line.alias("line"))


def content_digest(x):
    """Digest of the set of one file whose content is the lines of a symbol in order of their sessions."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session", "line"))), lambda r: r["line"]), "\n"), F.lit("\n"))
    return x.groupBy("symbol").agg(F.sha2(F.sha2(text, 256), 256).alias("expected"))


def landed_with_pins(spark, sf):
    """A snapshot of a file for each symbol, and pins taken from the panel: those of funds when their last session was not in yet."""
    def build():
        path, x = scratch_path(spark, "pinned"), lines(spark, sf)
        x.select("symbol", "session", "line").repartition("symbol").sortWithinPartitions("symbol", "session").select("symbol", "line").write.partitionBy("symbol").text(path)
        old = x.join(F.broadcast(x.agg(F.max("session").alias("last")))).where((F.col("asset_type") != "etf") | (F.col("session") < F.col("last")))
        pins = content_digest(old).select(F.concat(F.lit("symbol="), F.col("symbol")).alias("partition"), "expected")
        return L.pinned_partitions(spark, path, pins).withColumn("folder", F.lit(path))

    return P.kept(spark, sf, "pinned-partitions", build)


@query("SRC-21 QA-14", "partition #n_files digest matches", parts="landed_pins", sql="SELECT 'symbol=' || symbol AS partition, 1 AS n_files, sha256(content) AS digest, content = pinned AS matches FROM landed_pins")
def hash_pinned_files(spark, sf):
    """Set digests of the partitions of a landed snapshot against a pin table."""
    return landed_with_pins(spark, sf)


@query("SRC-21", "symbol #n ~total", parts="bars landed_pins", sql="SELECT symbol, count(*) AS n, sum(round(close*100))/100 AS total FROM bars WHERE symbol IN (SELECT symbol FROM landed_pins WHERE content = pinned) GROUP BY symbol")
def rows_of_pinned_partitions(spark, sf):
    """Rows of the partitions that match their pins; the others are not read."""
    good = [(r.folder, r.partition) for r in landed_with_pins(spark, sf).where("matches").select("folder", "partition").collect()]
    if not good:
        return spark.createDataFrame([], "symbol string, n bigint, total double")
    x = spark.read.option("basePath", good[0][0]).text([f"{a}/{b}" for a, b in good])
    return x.groupBy("symbol").agg(F.count("*").alias("n"), (F.sum(F.split("value", ",")[1].cast("double")) / 100).alias("total"))


@query("SRC-12", "#page_id start end url scheduled", parts="event_days", sql="""
SELECT year(event_day) AS page_id, event_day AS start, event_day + CAST(CASE WHEN day(event_day) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS "end", CASE WHEN year(event_day) % 2 = 0 THEN '/m/' || strftime(event_day, '%Y%m%d') END AS url, day(event_day) % 5 <> 0 AS scheduled FROM event_days""")
def meeting_calendar(spark, sf):
    """Calendar pages in the two layouts, every meeting printed twice, read back to start, end and link."""
    d = F.col("event_day")
    two = F.dayofmonth(d) % 2 == 0
    end = F.date_add(d, two.cast("int"))
    months = F.when(F.month(end) != F.month(d), F.concat(F.date_format(d, "MMMM"), F.lit("/"), F.date_format(end, "MMMM"))).otherwise(F.date_format(d, "MMMM"))
    days = F.when(two, F.concat(F.date_format(d, "d"), F.lit("-"), F.date_format(end, "d"))).otherwise(F.date_format(d, "d"))
    odd = F.dayofmonth(d) % 5 == 0
    box = F.concat(F.lit("<div class='row'><div class=\"month\"><b>"), months, F.lit('</b></div><div class="x date">'), days, F.when(odd, " (unscheduled)").otherwise(""),
                   F.lit("<a href='/m/"), F.date_format(d, "yyyyMMdd"), F.lit("'></a></div></div>"))
    heading = F.concat(F.lit("<h5>"), months, F.lit(" "), days, F.when(odd, " Conference Call - ").otherwise(" Meeting - "), F.year(d).cast("string"), F.lit("</h5>"))
    html = F.when(F.year(d) % 2 == 0, box).otherwise(heading)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(d.alias("d"), html.alias("h")))), lambda r: r["h"]), "")
    pages = P.event_days(spark, sf).groupBy(F.year(d).cast("bigint").alias("page_id")).agg(
        F.concat(F.lit("<h2>All</h2><h4>"), F.first(F.year(d).cast("string")), F.lit(" Meetings</h4><p>Text 1-2</p>"), body, body).alias("html"))
    return PG.meetings(PG.page_items(pages))


@query("SRC-11", "symbol name sector industry date_added cik", parts="bars", sql="""
SELECT replace(symbol,'_','-') AS symbol, 'Name of ' || symbol AS name, sector, asset_type AS industry, min(session) AS date_added, lpad(regexp_extract(symbol,'([0-9]+)',1), 6, '0') AS cik FROM bars GROUP BY ALL""")
def index_constituents(spark, sf):
    """A constituents table whose sector cells span the rows of a sector, with decoys of other ids, read back."""
    s = P.bars(spark, sf).groupBy("symbol", "sector", "asset_type").agg(F.min("session").alias("added"))
    cells = F.struct("symbol", F.concat(F.lit("<td>"), F.lower(F.replace("symbol", F.lit("_"), F.lit("."))), F.lit("</td><td>Name of <i>"), F.col("symbol"), F.lit("</i></td>")).alias("a"),
                     F.concat(F.lit("<td>"), F.col("asset_type"), F.lit("</td><td>x</td><td>"), F.date_format("added", "yyyy-MM-dd"), F.lit("</td><td>"), F.lpad(F.regexp_extract("symbol", "([0-9]+)", 1), 6, "0"), F.lit("</td></tr>")).alias("b"))
    g = s.groupBy("sector").agg(F.array_sort(F.collect_list(cells)).alias("rows"))
    span = F.concat(F.lit("<td rowspan='"), F.size("rows").cast("string"), F.lit("'>"), F.col("sector"), F.lit("</td>"))
    text = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("<tr>"), r["a"], F.when(i == 0, span).otherwise(""), r["b"])), "")
    page = g.select(F.xxhash64("sector").alias("page_id"), F.concat(
        F.lit("<table id='other'><tr><td>A</td><td>B</td><td>C</td><td>D</td></tr></table><table id='constituents'><tr><th>Symbol</th><th>Security</th><th>Sector</th><th>Industry</th><th>HQ</th><th>Added</th><th>CIK</th></tr>"), text, F.lit("</table>")).alias("html"))
    return PG.constituents(PG.table_grid(page)).withColumn("symbol", F.replace("symbol", F.lit("."), F.lit("-")))
