"""Landed sources and sinks. Landed documents are rendered from the given tables inside Spark, then parsed."""

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.scalar import tolerant_date  # noqa: F401
from ..operators.families import REVERSAL
from ..session import scratch_path
from ..sources import landed as L
from ..sources import pages as PG
from ..sources import panel as P
from ..sources import snapshot as SN
from ..sources.ticks import ticks
from .catalog import query
from .joins import eps
from .oracle_parts import part


def documents(bars, body):
    """One document per symbol and year: at most a year's sessions per group."""
    return bars.groupBy("symbol", F.year("session").alias("y")).agg(body.alias("body"))


@query("SRC-01 UDF-05", "symbol session ~close ~adjusted_close", parts="bars", sql="SELECT symbol, session, close, CASE WHEN symbol < 'NATION_2' THEN close ELSE adjusted_close END AS adjusted_close FROM bars")
def canonical_bars(spark, sf):
    rows = P.bars(spark, sf).drop("session").withColumn("adjusted_close", F.when(F.col("symbol") < "NATION_2", None).otherwise(F.col("adjusted_close")))
    return L.canonical(rows)


@query("SRC-02", "symbol session ~open ~close ~volume ~adjusted_close ~dividend ~split_factor", parts="bars", sql="SELECT symbol, session, open, close, volume, adjusted_close, dividend, split_factor FROM bars")
def vendor_json_bars(spark, sf):
    row = F.struct(F.date_format("session", "yyyy-MM-dd'T'00:00:00").alias("date"), "open", "high", "low", "close", "volume", F.col("adjusted_close").alias("adjClose"),
                   F.col("dividend").alias("divCash"), F.col("split_factor").alias("splitFactor"))
    return L.vendor_json(documents(P.bars(spark, sf), F.to_json(F.collect_list(row))))


@query("SRC-03", "symbol session ~open ~close ~volume limitation", parts="bars", sql="SELECT symbol, session, open, close, volume, 'NO_ACTION_COLUMNS' AS limitation FROM bars")
def vendor_csv_bars(spark, sf):
    line = F.concat_ws(",", F.date_format("session", "yyyy-MM-dd"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    return L.vendor_csv(P.bars(spark, sf).select("symbol", line.alias("line")))


@query("SRC-04", "symbol session ~close duplicate", parts="bars", sql="SELECT symbol, session, close, false AS duplicate FROM bars WHERE session BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def bulk_archive_bars(spark, sf):
    b = P.bars(spark, sf)
    line = lambda per: F.concat_ws(",", "symbol", F.lit(per), F.date_format("session", "yyyyMMdd"), F.lit("000000"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")], F.lit("0"))
    x = b.select(F.col("symbol").alias("member"), F.explode(F.array(line("D"), line("5"))).alias("line"))
    return L.bulk_archive(x, "1997-01-01", "1999-12-31")


@query("SRC-05", "symbol session ~close ~adjusted_close ~dividend ~split_factor malformed", parts="bars", sql="SELECT symbol, session, close, adjusted_close, dividend, split_factor, false AS malformed FROM bars")
def chart_json_bars(spark, sf):
    epoch = F.unix_timestamp("event_time")
    keyed = lambda test, value: F.map_from_entries(F.array_compact(F.collect_list(F.when(test, F.struct(epoch.cast("string").alias("k"), value)))))
    body = F.to_json(F.struct(
        F.collect_list(epoch).alias("timestamp"), *[F.collect_list(c).alias(c) for c in ("open", "high", "low", "close", "volume")], F.collect_list("adjusted_close").alias("adjclose"),
        keyed(F.col("dividend") != 0, F.struct(F.col("dividend").alias("amount"))).alias("dividends"),
        keyed(F.col("split_factor") != 1, F.struct(F.col("split_factor").alias("numerator"), F.lit(1.0).alias("denominator"))).alias("splits")))
    return L.chart_json(documents(P.bars(spark, sf), body))


@query("SRC-06", "symbol provider #n", parts="bars bars_b", sql="""
WITH a AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), b AS (SELECT symbol, count(*) AS n FROM bars_b GROUP BY symbol)
SELECT symbol, CASE WHEN b.n >= a.n*0.55 THEN 'B' ELSE 'A' END AS provider, CASE WHEN b.n >= a.n*0.55 THEN b.n ELSE a.n END AS n FROM a LEFT JOIN b USING (symbol)""")
def provider_fallback(spark, sf):
    a, b = P.bars(spark, sf).withColumn("provider", F.lit("A")), P.second_provider(spark, sf).withColumn("provider", F.lit("B"))
    need = P.bars(spark, sf).groupBy("symbol").agg((F.count("*") * 0.55).alias("need"))
    return L.first_complete_provider(a.unionByName(b), ["B", "A"], need).groupBy("symbol", "provider").agg(F.count("*").alias("n"))


@query("SRC-07", "symbol ~price #delay_seconds halted", sql="SELECT user_id::VARCHAR AS symbol, arg_max(value, (ts, event_id)) AS price, 45 AS delay_seconds, arg_max(event_type, (ts, event_id)) = 'error' AS halted FROM events GROUP BY user_id")
def latest_quotes(spark, sf):
    t = ticks(spark, sf)
    q = t.select(F.col("user_id").cast("string").alias("symbol"), "price", F.col("ts").alias("provider_time"), (F.col("ts") + F.expr("INTERVAL 45 SECONDS")).alias("received_at"), (F.col("symbol") == "error").alias("halted"))
    return L.latest_quotes(q)


@query("SRC-08", "session ~market ~rf available", parts="mkt", sql="""
SELECT session, round(mkt*100,4)/100 + 0.0001 AS market, 0.0001 AS rf, strftime(timezone('UTC', timezone('America/New_York', session + 1 + INTERVAL 8 HOUR)), '%Y-%m-%d %H:%M:%S') AS available FROM mkt WHERE mkt IS NOT NULL""")
def factor_file(spark, sf):
    from ..operators.features import market_return

    m = market_return(P.with_returns(spark, sf)).where("mkt is not null")
    line = F.concat_ws(",", F.date_format("session", "yyyyMMdd"), F.round(F.col("mkt") * 100, 4).cast("string"), F.lit("0.1"), F.lit("0.2"), F.lit("0.01"))
    lines = m.select(F.explode(F.array(line, F.lit("This file was created from the panel"))).alias("line"))
    return L.factor_lines(lines).withColumn("available", clock.stamp("available_at"))


@query("SRC-09 SRC-10 SRC-19 ASM-04", "session series_id ~value", parts="mkt rate_series", sql="""
SELECT session, 'MARKET' AS series_id, round(mkt, 6) AS value FROM mkt WHERE mkt IS NOT NULL AND session <> DATE '1997-06-02' UNION ALL SELECT d, 'RATE_' || series[1], round(rate, 6) FROM rate_series""")
def reference_series(spark, sf):
    from ..operators.features import market_return
    from .joins import PRIORITIES, rate_series

    m = market_return(P.with_returns(spark, sf)).where("mkt is not null")
    text = F.when(F.col("session") == F.lit("1997-06-02").cast("date"), ".").otherwise(F.round("mkt", 6).cast("decimal(18,6)").cast("string"))
    a = L.reference_lines(m.select(F.concat_ws(",", F.date_format("session", "yyyy-MM-dd"), text).alias("line")), "MARKET", 12)
    line = F.concat_ws(",", F.date_format("d", "yyyy-MM-dd"), F.round("rate", 6).cast("decimal(18,6)").cast("string")).alias("line")
    names = {f"RATE_{p[0]}": p for p in PRIORITIES}
    for name, priority in names.items():
        a = a.unionByName(L.reference_lines(rate_series(spark, sf).where(F.col("series") == priority).select(line), name, 16))
    ids = ["MARKET", *names]
    return L.signed_observations(L.wide_reference(a, ids), ids)


@query("SRC-11", "#page_id kind #table_no #row_no #n_cells")
def page_table_rows(spark, sf):
    return PG.page_rows(P.table(spark, sf, "pages")).withColumn("n_cells", F.size("cells"))


@query("SRC-11", "#page_id #row_no effective added removed")
def membership_change_page(spark, sf):
    """The change log rendered as one HTML page per symbol, then read back."""
    from ..operators.membership import change_log

    c = change_log(P.memberships(spark, sf))
    tr = F.format_string("<tr><td>%s</td><td>%s</td><td>x</td><td>%s</td></tr>", F.date_format("effective", "MMMM d, yyyy"),
                         F.when(F.col("action") == "ADD", F.col("symbol")).otherwise(""), F.when(F.col("action") == "REMOVE", F.col("symbol")).otherwise(""))
    pages = c.groupBy(F.xxhash64("symbol").alias("page_id")).agg(F.concat(F.lit("<table>"), F.array_join(F.array_sort(F.collect_list(tr)), ""), F.lit("</table>")).alias("html"))
    return PG.change_rows(PG.page_rows(pages))


@query("SRC-12", "#page_id mention")
def calendar_page_mentions(spark, sf):
    cal = P.event_days(spark, sf).groupBy(F.year("event_day").alias("page_id")).agg(
        F.concat(F.lit("<h2>Calendar</h2><p>"), F.array_join(F.array_sort(F.collect_list(F.date_format("event_day", "MMMM d"))), ", "), F.lit("</p>")).alias("html"))
    return PG.meeting_days(PG.page_rows(cal.withColumn("page_id", F.col("page_id").cast("bigint"))))


FORM = "CASE kind WHEN 'EARNINGS' THEN '8-K' WHEN 'GUIDANCE_NEGATIVE' THEN '8-K/A' WHEN 'HALT' THEN '10-Q' ELSE '4' END"


def filings(spark, sf):
    a = P.announcements(spark, sf)
    cols = {"accessionNumber": F.col("event_id").cast("string"), "form": F.expr(FORM), "items": F.when(F.col("kind") == "EARNINGS", "2.02,9.01").when(F.col("kind") == "GUIDANCE_NEGATIVE", "7.01").otherwise(""),
            "acceptanceDateTime": F.when(F.col("kind") == "OTHER", F.date_format("event_day", "yyyy-MM-dd")).otherwise(F.date_format("event_day", "yyyy-MM-dd'T'16:05:00")), "primaryDocument": F.lit("d.htm")}
    docs = a.select("symbol", F.to_json(F.struct(*[F.array(v).alias(k) for k, v in cols.items()])).alias("body"))
    return L.filing_rows(docs)


@query("SRC-13 STR-12", "symbol accession #year", parts="anns", sql="SELECT symbol, event_id::VARCHAR AS accession, year(event_day) AS year FROM anns WHERE kind = 'EARNINGS'")
def earnings_filings(spark, sf):
    return L.earnings_announcements(filings(spark, sf)).select("symbol", F.col("accessionNumber").alias("accession"), F.substring("acceptanceDateTime", 1, 4).cast("int").alias("year"))


@query("SRC-15", "event_id symbol kind accepted", parts="anns", sql="""
SELECT substring(sha256(symbol || '|' || event_id),1,24) AS event_id, symbol, CASE kind WHEN 'EARNINGS' THEN 'EARNINGS' WHEN 'GUIDANCE_NEGATIVE' THEN 'GUIDANCE' ELSE 'PERIODIC_REPORT' END AS kind, strftime(event_day, '%Y-%m-%d') || ' 16:05:00' AS accepted FROM anns WHERE kind <> 'OTHER'""")
def typed_filing_events(spark, sf):
    return L.filing_events(filings(spark, sf)).withColumn("accepted", clock.stamp("accepted_at"))


@query("SRC-14", "symbol frame end ~value filed", parts="eps", sql="""SELECT symbol, 'CY' || (q//4) || 'Q' || (q%4+1) AS frame, quarter_end AS "end", value, filed FROM eps""")
def quarterly_eps(spark, sf):
    frame = F.concat(F.lit("CY"), F.floor(F.col("q") / 4).cast("string"), F.lit("Q"), (F.col("q") % 4 + 1).cast("string"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    q = F.struct(day("quarter_end").alias("end"), F.col("value").alias("val"), day("filed").alias("filed"), F.lit("10-Q").alias("form"), frame.alias("frame"))
    y = F.struct(day("quarter_end").alias("end"), F.col("value").alias("val"), day("filed").alias("filed"), F.lit("10-K").alias("form"), F.substring(frame, 1, 6).alias("frame"))
    docs = eps(spark, sf).select("symbol", F.explode(F.array(q, y)).alias("e")).groupBy("symbol").agg(
        F.to_json(F.struct(F.create_map(F.lit("USD/shares"), F.collect_list("e")).alias("units"))).alias("body"))
    return L.quarterly_concept(docs)


@query("SRC-16", "file #section name ~total #n", parts="bars", sql="""
SELECT symbol AS file, 1 AS section, 'close' AS name, sum(close) AS total, count(*) AS n FROM bars GROUP BY symbol UNION ALL SELECT symbol, 2, 'volume', sum(volume), count(*) FROM bars GROUP BY symbol
UNION ALL SELECT symbol, 1, 'stub_1', NULL, count(*) FROM bars GROUP BY symbol UNION ALL SELECT symbol, 2, 'stub_1', NULL, count(*) FROM bars GROUP BY symbol""", digits=4)
def sectioned_weekly_file(spark, sf):
    day = F.datediff("session", F.lit("1990-01-01").cast("date"))
    b = P.bars(spark, sf)
    rows = lambda c, off: b.select(F.col("symbol").alias("file"), (day + off).alias("n"), F.concat_ws(",", F.concat(F.lit("d"), F.date_format("session", "yyyy-MM-dd")), F.col(c).cast("decimal(18,2)").cast("string")).alias("line"))
    head = lambda c, n: b.select(F.col("symbol").alias("file")).distinct().select("file", F.lit(n).alias("n"), F.lit(f"STUB_1,{c.title()}").alias("line"))
    x = head("close", 0).unionByName(rows("close", 0)).unionByName(head("volume", 100_000)).unionByName(rows("volume", 100_000))
    return L.sectioned_lines(x).groupBy("file", "section", "name").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


# A contract for each priority.
CONTRACTS = {"1-URGENT": "067411", "2-HIGH": "067511", "3-MEDIUM": "067651", "4-NOT SPECIFIED": "067655", "5-LOW": "06765A"}


@query("SRC-18", "contract report_date ~net ~net_share ~open_interest available", sql="""
SELECT contract, d AS report_date, net, net/oi AS net_share, oi AS open_interest, strftime(timezone('UTC', timezone('America/New_York', d + 3 + INTERVAL '15 hours 30 minutes')), '%Y-%m-%d %H:%M:%S') AS available FROM (
SELECT contract, d, max_by(l - s, (oi, l)) AS net, max(oi) AS oi FROM (SELECT CASE o_orderpriority[1] WHEN '1' THEN '067411' WHEN '2' THEN '067511' WHEN '3' THEN '067651' WHEN '4' THEN '067655' ELSE '06765A' END AS contract, CAST(o_orderdate AS DATE) AS d, round(o_totalprice,0) AS oi, round(o_totalprice*0.6,0) AS l, round(o_totalprice*0.25,0) AS s FROM orders) GROUP BY ALL)""")
def positioning_reports(spark, sf):
    """Reports of all five contracts, rendered from all orders."""
    code = F.create_map(*[F.lit(x) for pair in CONTRACTS.items() for x in pair])[F.col("o_orderpriority")]
    number = lambda f: F.format_number(F.round(F.col("o_totalprice") * f, 0), 0)
    rec = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), code.alias("contract"),
                   number(0.6).alias("long_all"), number(0.25).alias("short_all"), number(1.0).alias("open_interest"))
    docs = P.table(spark, sf, "orders").select(F.to_json(F.array(rec)).alias("body"))
    return L.positioning(docs, *CONTRACTS.values()).withColumn("available", clock.stamp("available_at"))


def snapshot(spark, sf):
    def build():
        return SN.representations(P.bars(spark, sf)).withColumn("year", F.year("session"))

    key = f"snapshot-{spark.sparkContext.applicationId}-{sf}"
    if key not in _PATHS:
        _PATHS[key] = scratch_path(spark, "snapshot")
        SN.write_snapshot(P.bars(spark, sf), _PATHS[key])
    return _PATHS[key]


_PATHS: dict[str, str] = {}


@query("SRC-24 SRC-25", "symbol session ~close", parts="bars", sql="SELECT symbol, session, adjusted_close AS close FROM bars")
def snapshot_adjusted_closes(spark, sf):
    return SN.read_snapshot(spark, snapshot(spark, sf))


@query("SRC-28", "symbol session ~open ~close ~adjusted_close", parts="bars", sql="SELECT symbol, session, open, close, adjusted_close FROM bars")
def rebuilt_bars(spark, sf):
    return SN.rebuild_bars(spark.read.parquet(snapshot(spark, sf)))


@query("SRC-26", "asset snapshot_id", parts="anns", sql="SELECT symbol AS asset, max_by(event_id, (available_day, event_id)) AS snapshot_id FROM anns GROUP BY symbol")
def latest_snapshot_per_asset(spark, sf):
    return SN.latest_snapshots(P.announcements(spark, sf).select(F.col("symbol").alias("asset"), F.col("available_day").alias("fetched_at"), F.col("event_id").alias("snapshot_id")))


@query("SRC-27", "symbol session ~close ~volume", parts="bars", sql="SELECT symbol, session, close, volume FROM bars")
def long_research_panel(spark, sf):
    """Two providers overlap; the one of the lower rank counts where both have a session."""
    own = P.bars(spark, sf).select("symbol", "session", "close", "volume", F.lit(1).alias("source_rank"))
    other = P.bars(spark, sf).select("symbol", "session", (F.col("close") * 1.01).alias("close"), (F.col("volume") + 1).alias("volume"), F.lit(2).alias("source_rank"))
    row = F.min_by(F.struct("close", "volume"), "source_rank").alias("row")
    return own.unionByName(other).groupBy("symbol", "session").agg(row).select("symbol", "session", "row.close", "row.volume")


@query("SNK-01", "symbol #n_rows written again", parts="bars", sql="SELECT symbol, count(*) AS n_rows, true AS written, false AS again FROM bars GROUP BY symbol")
def immutable_artifact(spark, sf):
    """The bars under their digest, written twice: the second write finds the first and leaves it."""
    root, b = scratch_path(spark, "artifacts"), P.bars(spark, sf).select("symbol", "session", "close", "volume")
    path, written = SN.write_artifact(b, root)
    _, again = SN.write_artifact(b.repartition(3, "session"), root)
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("n_rows")).select("*", F.lit(written).alias("written"), F.lit(again).alias("again"))


@query("SNK-02", "trial verdict evidence annotations")
def verdict_rows(spark, sf):
    from .validation import verdict_table

    v = verdict_table(spark, sf).select("trial", "verdict", F.struct("mean", "t", "oos_t").alias("e"), F.create_map(F.lit("decay"), F.col("decay")).alias("a"))
    path = scratch_path(spark, "verdicts")
    L.verdict_csv(v.select("trial", "verdict", F.to_json("e").alias("evidence"), F.to_json("a").alias("annotations")), path)
    return spark.read.option("header", True).option("escape", '"').schema("trial string, verdict string, evidence string, annotations string").csv(path)


@query("ASM-15", "trial session ~net", digits=5, parts="streams", sql="SELECT trial, session, net FROM streams")
def wide_streams_to_long(spark, sf):
    from .inference import streams

    s = streams(spark, sf)
    names = ["|".join((g, str(k), d)) for g in REVERSAL["signal"] for k in REVERSAL["breadth"] for d in REVERSAL["side"]]
    wide = s.groupBy("session").pivot("trial", names).agg(F.max("net"))
    return wide.unpivot("session", [F.col(f"`{n}`") for n in names], "trial", "net").where("net is not null")
