"""Causal joins and set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import calendar as C
from ..operators import events as E
from ..operators import filters as X
from ..operators.asof import asof_join
from ..operators.trials import seed_of, with_controls
from ..sources import panel as P
from ..sources.ticks import ticks
from .catalog import query
from .inference import streams
from .oracle_parts import part


@query("JOIN-02", "#event_id ~last_view #seconds_since", sql="""
SELECT p.event_id, v.value AS last_view, date_diff('microsecond', v.ts, p.ts)//1000000 AS seconds_since FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""".replace("date_diff('microsecond', v.ts, p.ts)//1000000", "coalesce(date_diff('microsecond', v.ts, p.ts)//1000000, -1)"))
def latest_view_before_purchase(spark, sf):
    t = ticks(spark, sf)
    j = asof_join(t.where("symbol = 'purchase'").select("event_id", "user_id", "ts"), t.where("symbol = 'view'").select("user_id", "ts", F.col("price").alias("last_view")),
                  ["user_id"], "ts", "ts", ["last_view"])
    gap = F.floor((F.unix_micros("ts") - F.unix_micros("matched_at")) / 1000000)
    return j.withColumn("seconds_since", F.coalesce(gap, F.lit(-1)))


@query("JOIN-02", "#event_id ~next_price", sql="""
SELECT p.event_id, CASE WHEN v.ts <= p.ts + INTERVAL 12 HOUR THEN v.value END AS next_price FROM (SELECT * FROM events WHERE event_type = 'signup') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') v ON p.user_id = v.user_id AND p.ts < v.ts""")
def next_click_within_tolerance(spark, sf):
    t = ticks(spark, sf)
    return asof_join(t.where("symbol = 'signup'").select("event_id", "user_id", "ts"), t.where("symbol = 'click'").select("user_id", "ts", F.col("price").alias("next_price")),
                     ["user_id"], "ts", "ts", ["next_price"], direction="forward", strict=True, tolerance=12 * 3600)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FINANCING = "5-LOW"  # the series that pays for leverage

part("rate_series", "", "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice)/1e7 AS rate FROM orders GROUP BY ALL")
part("rates", "rate_series", "SELECT d, rate FROM rate_series WHERE series = '5-LOW'")


def rate_series(spark, sf):
    """Five daily reference series: one row per series and day, usable the next morning."""
    def build():
        o = P.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("d"))
        return o.agg((F.avg("o_totalprice") / 1e7).alias("rate")).withColumn("available_at", clock.new_york_instant(F.date_add("d", 1), 8))

    return P.kept(spark, sf, "rate_series", build)


@query("JOIN-02 JOIN-11 ASM-06", "series session ~rate ~financing", parts="cal rate_series", sql="""
SELECT c.series, c.session, r.rate, (r.rate + 0.03)/360 AS financing FROM (SELECT session, series FROM cal CROSS JOIN (SELECT DISTINCT series FROM rate_series)) c ASOF LEFT JOIN rate_series r ON r.series = c.series AND c.session >= r.d + 1""")
def reference_rate_at_close(spark, sf):
    """Every series on every session as it was known at the close."""
    r = rate_series(spark, sf)
    days = P.calendar(spark, sf).select("session", clock.market_close("session").alias("decision_at"))
    left = days.join(F.broadcast(r.select("series").distinct()))  # five names
    j = asof_join(left, r, ["series"], "decision_at", "available_at", ["rate"], bucket_seconds=86400 * 366)
    return j.withColumn("financing", (F.col("rate") + 0.03) / 360)


@query("JOIN-03", "event_id symbol first_session", parts="anns civil", sql="SELECT event_id, symbol, c.after AS first_session FROM anns JOIN civil c ON c.day = available_day WHERE c.after IS NOT NULL")
def first_session_after_availability(spark, sf):
    days = C.civil(P.calendar(spark, sf)).select(F.col("day").alias("available_day"), F.col("after").alias("first_session"))
    return P.announcements(spark, sf).join(days, "available_day").where("first_session is not null")


part("eps", "", """
SELECT n_name AS symbol, year(o_orderdate)*4+quarter(o_orderdate)-1 AS q, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end,
 CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 60 AS filed, round(avg(o_totalprice)/1e5, 6) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")


@query("JOIN-05", "symbol quarter_end available source", parts="eps anns", sql="""
SELECT e.symbol, e.quarter_end, CASE WHEN a.d <= e.filed THEN a.d ELSE e.filed END AS available, CASE WHEN a.d <= e.filed THEN 'ANNOUNCEMENT' ELSE 'FILING' END AS source FROM eps e
LEFT JOIN (SELECT e.symbol, e.q, min(a.event_day) AS d FROM eps e JOIN anns a ON a.symbol = e.symbol AND a.kind = 'EARNINGS' AND a.event_day > e.quarter_end AND a.event_day <= e.quarter_end + 90 GROUP BY ALL) a ON a.symbol = e.symbol AND a.q = e.q""")
def announcement_or_filing(spark, sf):
    return E.attach_availability(eps(spark, sf), P.announcements(spark, sf).where("kind = 'EARNINGS'"))


def eps(spark, sf):
    o, c, n = (P.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    q = F.trunc(F.to_date("o_orderdate"), "QUARTER")
    end = F.date_sub(F.add_months(q, 3), 1)
    return P.kept(spark, sf, "eps", lambda: x.groupBy(
        F.col("n_name").alias("symbol"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("q"), end.alias("quarter_end")).agg(
        F.round(F.avg("o_totalprice") / 1e5, 6).alias("value")).withColumn("filed", F.date_add("quarter_end", 60)))


@query("WIN-48", "symbol #q ~difference ~sue", digits=4, parts="eps", sql="""
WITH d AS (SELECT a.symbol, a.q, a.value - b.value AS difference FROM eps a JOIN eps b ON a.symbol = b.symbol AND b.q = a.q - 4)
SELECT symbol, q, difference, difference/sd AS sue FROM (SELECT *, count(*) OVER w AS n, stddev_samp(difference) OVER w AS sd FROM d WINDOW w AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) WHERE n >= 6 AND sd > 1e-9""")
def standardized_unexpected_earnings(spark, sf):
    return E.unexpected_earnings(eps(spark, sf))


@query("JOIN-06", "symbol session sector asset_type ~close", parts="bars", sql="SELECT symbol, session, sector, asset_type, close FROM bars")
def sector_lookup(spark, sf):
    names = P.table(spark, sf, "nation").select(F.col("n_name").alias("symbol"), F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("sector"))
    return P.bars(spark, sf).drop("sector").join(names, "symbol", "left")


part("ledger", "", """
SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS rec, CASE event_type WHEN 'view' THEN 'FILL' WHEN 'click' THEN 'MARK' ELSE 'EXIT' END AS event, ts, value AS price, event_id
FROM events WHERE event_type IN ('view','click','purchase')""")


@query("JOIN-08 AGG-14", "recommendation_id ~fill ~exit_price ~ret status", parts="ledger", sql="""
WITH f AS (SELECT rec, arg_min(price, (ts, event_id)) AS fill, min(ts) AS at FROM ledger WHERE event = 'FILL' GROUP BY rec),
 x AS (SELECT f.rec, arg_min(price, (ts, event_id)) AS exit_price FROM f JOIN ledger l ON l.rec = f.rec AND l.event = 'EXIT' AND l.ts > f.at GROUP BY f.rec)
SELECT f.rec AS recommendation_id, fill, exit_price, exit_price/fill-1 AS ret, CASE WHEN x.rec IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM f LEFT JOIN x ON x.rec = f.rec""")
def fills_with_exits(spark, sf):
    return E.scorecard_rows(ledger(spark, sf))


def ledger(spark, sf):
    t = ticks(spark, sf).where("symbol in ('view', 'click', 'purchase')")
    kind = F.when(F.col("symbol") == "view", "FILL").when(F.col("symbol") == "click", "MARK").otherwise("EXIT")
    return t.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("recommendation_id"), kind.alias("event"),
                    F.col("ts").alias("at"), "price", "event_id", F.concat(F.lit("lane"), F.pmod("user_id", F.lit(5)).cast("string")).alias("lane"))


@query("JOIN-10", "#event_id kind fill_day", sql="""
WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE isodow(ts) <= 5),
 k AS (SELECT d, (d + INTERVAL '9 hours 30 minutes') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS o, (d + INTERVAL '16 hours') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS c FROM s)
SELECT event_id, kind, fill_day FROM (
SELECT e.event_id, 'OPEN' AS kind, (SELECT min(d) FROM k WHERE k.o > e.ts) AS fill_day FROM events e WHERE event_type = 'signup'
UNION ALL SELECT e.event_id, 'CLOSE', (SELECT min(d) FROM k WHERE k.c > e.ts) FROM events e WHERE event_type = 'signup') WHERE fill_day IS NOT NULL""")
def next_eligible_execution(spark, sf):
    t = ticks(spark, sf)
    cal = P.number_sessions(t.select("session").distinct().where("weekday(session) < 5"))
    return E.next_execution(t.where("symbol = 'signup'").select("event_id", "ts"), cal)


@query("JOIN-12 FUN-02", "spec parent kind seed", parts="streams", sql="""
SELECT trial || CASE WHEN kind = 'REAL' THEN '' ELSE '|' || kind END AS spec, trial AS parent, kind, CASE WHEN kind <> 'REAL' THEN CAST(CAST('0x' || substring(h,15,2) || substring(h,13,2) || substring(h,11,2) || substring(h,9,2) || substring(h,7,2) || substring(h,5,2) || substring(h,3,2) || substring(h,1,2) AS UBIGINT) AS VARCHAR) END AS seed
FROM (SELECT *, sha256('0:' || trial || ':' || kind) AS h FROM (SELECT DISTINCT trial FROM streams) CROSS JOIN (VALUES ('REAL'),('SHUFFLED_DATES'),('MATCHED_RANDOM')) k(kind))""")
def trials_with_controls(spark, sf):
    x = with_controls(streams(spark, sf).select("trial").distinct())
    return x.withColumn("seed", F.col("seed").cast("string"))


@query("JOIN-14 SET-03", "symbol session", parts="bars bars_b", sql="SELECT symbol, session FROM bars WHERE close > 0 INTERSECT SELECT symbol, session FROM bars_b WHERE close > 0")
def common_sessions(spark, sf):
    valid = lambda d: d.where("close > 0").select("symbol", "session")
    return valid(P.bars(spark, sf)).intersect(valid(P.second_provider(spark, sf)))


@query("SET-03", "symbol", parts="bars anns", sql="SELECT symbol FROM bars INTERSECT SELECT symbol FROM anns WHERE kind = 'HALT'")
def common_symbols(spark, sf):
    return P.bars(spark, sf).select("symbol").intersect(P.announcements(spark, sf).where("kind = 'HALT'").select("symbol"))


@query("SET-04 SRC-23", "symbol session representation ~open ~close ~volume", parts="bars", sql="""
SELECT symbol, session, 'raw' AS representation, open, close, volume FROM bars UNION ALL SELECT symbol, session, 'adjusted', open*adjusted_close/close, adjusted_close, volume/(adjusted_close/close) FROM bars
UNION ALL SELECT symbol, session, 'actions', NULL, CASE WHEN dividend <> 0 THEN dividend ELSE split_factor END, NULL FROM bars WHERE dividend <> 0 OR split_factor <> 1""")
def price_representations(spark, sf):
    from ..sources.snapshot import representations

    return representations(P.bars(spark, sf))


@query("SET-06", "event_id symbol session kind ~value", parts="bars", sql="""
SELECT substring(sha256(symbol || '|' || strftime(session,'%Y-%m-%d') || '|' || kind),1,24) AS event_id, symbol, session, kind, value FROM (
SELECT symbol, session, 'DIVIDEND' AS kind, dividend AS value FROM bars WHERE dividend <> 0 UNION ALL SELECT symbol, session, 'SPLIT', split_factor FROM bars WHERE split_factor <> 1)""")
def corporate_actions(spark, sf):
    return E.actions_as_events(P.bars(spark, sf))


@query("SET-01", "symbol session change #names", parts="rev5 cal", sql="""
WITH e AS (SELECT session, row_number() OVER (ORDER BY session) AS k FROM (SELECT max(session) AS session FROM cal GROUP BY date_trunc('month', session))),
 s AS (SELECT e.k, e.session, symbol, names FROM (SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS r, floor(count(*) OVER (PARTITION BY session)/5) AS names FROM rev5 WHERE rev IS NOT NULL AND asset_type = 'equity') JOIN e USING (session) WHERE r <= names AND names >= 2)
SELECT symbol, (SELECT session FROM e WHERE e.k = coalesce(a.k, b.k+1)) AS session, CASE WHEN b.k IS NULL THEN 'ENTER' ELSE 'LEAVE' END AS change, coalesce(a.names, b.names) AS names
FROM s a FULL JOIN s b USING (symbol) WHERE false UNION ALL
SELECT a.symbol, a.session, 'ENTER', a.names FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.symbol = a.symbol AND b.k = a.k - 1)
UNION ALL SELECT b.symbol, e.session, 'LEAVE', b.names FROM s b JOIN e ON e.k = b.k + 1 WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.symbol = b.symbol AND a.k = b.k + 1)""")
def selection_changes(spark, sf):
    from ..operators.monthly import numbered_month_ends, selection_changes as changes
    from .tops import monthly_top_fraction

    return changes(monthly_top_fraction(spark, sf), numbered_month_ends(P.calendar(spark, sf)))
