"""Filters and row rules."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import filters as X
from ..operators import membership as M
from ..operators.frames import framed, shifted
from ..operators.portfolio import overlapping_cohorts  # noqa: F401
from ..sources import panel as P
from ..sources.ticks import ticks
from .catalog import query
from .tops import rev5
from .windows import bollinger_percent_b, moving_average_regimes, recursive_indicators

CUT = "1998-03-02 21:00:00"


@query("FLT-01 FLT-03 STR-01", "symbol session ~close available", parts="bars", sql=f"""
SELECT symbol, session, close, strftime(t, '%Y-%m-%d %H:%M:%S') AS available FROM (SELECT *,
 ((session + INTERVAL 16 HOUR + INTERVAL 15 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS t FROM bars) WHERE t <= TIMESTAMP '{CUT}'""")
def as_of_bars(spark, sf):
    x = X.assert_as_of(X.as_of(P.bars(spark, sf), CUT), CUT)
    return x.withColumn("available", clock.stamp("available_at"))


@query("FLT-02", "event_id symbol kind ~value", parts="anns", sql="""
SELECT event_id, symbol, kind, value FROM anns WHERE available_day <= DATE '1999-06-30'""")
def vintage_prefix(spark, sf):
    from ..operators.quality import provenance_ok

    a = P.announcements(spark, sf).withColumn("available_at", F.col("available_day").cast("timestamp"))
    a = a.withColumn("fetched_at", F.col("available_at")).withColumn("content_hash", F.sha2(F.col("event_id").cast("string"), 256))
    return X.as_of(provenance_ok(a), "1999-06-30 00:00:00")


@query("FLT-04", "hypothesis #n_sessions", parts="flags", sql="""
WITH f AS (SELECT session, 'weekday' AS family, CAST(weekday AS VARCHAR) AS value FROM flags
 UNION ALL SELECT session, 'month', CAST(month AS VARCHAR) FROM flags
 UNION ALL SELECT session, 'opex', 'WEEK' FROM flags WHERE opex_week
 UNION ALL SELECT session, 'turn_of_month', CASE WHEN turn_of_month THEN 'TOM' ELSE 'REST' END FROM flags
 UNION ALL SELECT session, 'holiday', 'PRE' FROM flags WHERE pre_holiday UNION ALL SELECT session, 'holiday', 'POST' FROM flags WHERE post_holiday
 UNION ALL SELECT session, 'event', 'DAY_BEFORE' FROM flags WHERE event_day_before UNION ALL SELECT session, 'event', 'DAY_OF' FROM flags WHERE event_day_of
 UNION ALL SELECT session, 'event', 'EVENT_WEEK' FROM flags WHERE event_week
 UNION ALL SELECT session, 'month_end', CASE WHEN month_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags
 UNION ALL SELECT session, 'quarter_end', CASE WHEN quarter_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags)
SELECT family || '=' || value AS hypothesis, count(*) AS n_sessions FROM f GROUP BY ALL
UNION ALL SELECT a.family || '=' || a.value || '&' || b.family || '=' || b.value, count(*) FROM f a JOIN f b ON a.session = b.session AND a.family < b.family GROUP BY ALL""")
def calendar_predicate_conjunctions(spark, sf):
    from ..operators.trials import calendar_predicates, predicate_sessions, predicate_table

    grid = predicate_table(spark)
    return predicate_sessions(grid, calendar_predicates(P.calendar_table(spark, sf))).groupBy("hypothesis").agg(
        F.count("*").alias("n_sessions"))


@query("FLT-05 JOIN-04", "symbol session ~px", parts="bars members", sql="""
SELECT b.symbol, b.session, b.adjusted_close AS px FROM bars b WHERE asset_type = 'equity' AND EXISTS (
 SELECT 1 FROM members m WHERE m.symbol = b.symbol AND b.session >= m.start AND (m."end" IS NULL OR b.session < m."end"))""")
def eligible_members(spark, sf):
    x = P.placed(spark, sf).where("asset_type = 'equity' and close is not null")
    return M.during(x, P.memberships(spark, sf), how="left_semi")


@query("FLT-06 FUN-09", "symbol session reasons accepted ~reversal_atr", digits=5, parts="ewm own event_days cal", sql="""
SELECT symbol, session, rev_atr AS reversal_atr, rtrim(CASE WHEN rev_atr > 1 THEN 'PREENTRY_REVERSAL,' ELSE '' END || CASE WHEN ev THEN 'EVENT_WINDOW,' ELSE '' END
  || CASE WHEN sector = 'S4' THEN 'EVENT_DATA_MISSING,' ELSE '' END, ',') AS reasons, NOT (coalesce(rev_atr > 1, false) OR ev OR sector = 'S4') AS accepted
FROM (SELECT o.symbol, o.session, o.sector, greatest(lag(o.px) OVER (PARTITION BY o.symbol ORDER BY o.i) - o.px, 0) / CASE WHEN e.i >= 14 THEN e.atr END AS rev_atr,
 o.session IN (SELECT c.session FROM cal c JOIN (SELECT pos FROM cal WHERE session IN (SELECT event_day FROM event_days)) x ON abs(c.pos - x.pos) <= 5) AS ev
 FROM own o JOIN ewm e ON e.symbol = o.symbol AND e.i = o.i)""")
def prior_close_decisions(spark, sf):
    own = W.partitionBy("symbol").orderBy("session")
    near = P.calendar(spark, sf).join(P.event_days(spark, sf), F.col("session") == F.col("event_day")).select(
        F.explode(F.sequence(F.col("pos") - 5, F.col("pos") + 5)).alias("pos")).distinct().withColumn("ev", F.lit(True))
    x = P.placed(spark, sf).withColumn("drop", F.greatest(F.lag("px").over(own) - F.col("px"), F.lit(0.0)))
    x = x.withColumn("drop", F.when(F.lag("px").over(own).isNull(), F.lit(0.0)).otherwise(F.col("drop")))
    x = x.join(recursive_indicators(spark, sf).select("symbol", "session", "atr14"), ["symbol", "session"]).join(near, "pos", "left")
    x = x.withColumn("reversal_atr", F.col("drop") / F.col("atr14"))
    why = X.reasons(PREENTRY_REVERSAL=F.col("reversal_atr") > 1, EVENT_WINDOW=F.coalesce("ev", F.lit(False)), EVENT_DATA_MISSING=F.col("sector") == "S4")
    x = x.withColumn("_r", why)
    return x.select("symbol", "session", F.array_join("_r", ",").alias("reasons"), (F.size("_r") == 0).alias("accepted"), "reversal_atr")


@query("FLT-07", "symbol session side ~limit_price filled", parts="own", sql="""
SELECT symbol, session, side, limit_price, CASE side WHEN 'LONG' THEN auction <= limit_price ELSE auction >= limit_price END AS filled FROM (
SELECT symbol, session, side, round(px + CASE side WHEN 'LONG' THEN -1 ELSE 1 END * 0.25 * (high_adj - low_adj), 6) AS limit_price, lead(px) OVER (PARTITION BY symbol, side ORDER BY i) AS auction
FROM own CROSS JOIN (VALUES ('LONG'),('SHORT')) s(side)) WHERE auction IS NOT NULL""")
def close_auction_fills(spark, sf):
    own = W.partitionBy("symbol").orderBy("session")
    x = P.placed(spark, sf).withColumn("auction", F.lead("px").over(own)).where("auction is not null")
    x = x.select("symbol", "session", "px", "auction", (F.col("high_adj") - F.col("low_adj")).alias("rng"), F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side"))
    limit = F.round(F.col("px") + F.when(F.col("side") == "LONG", -1.0).otherwise(1.0) * F.lit(0.25) * F.col("rng"), 6)
    x = x.withColumn("limit_price", limit)
    return x.withColumn("filled", F.when(F.col("side") == "LONG", F.col("auction") <= F.col("limit_price")).otherwise(F.col("auction") >= F.col("limit_price")))


@query("FLT-08", "symbol session hold_end", parts="bars cal anns", sql="""
SELECT d.symbol, d.session, d.hold_end FROM (SELECT b.symbol, b.session, c2.session AS hold_end FROM bars b JOIN cal c USING (session) JOIN cal c2 ON c2.pos = c.pos + 21
 WHERE b.session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))) d
WHERE EXISTS (SELECT 1 FROM anns e WHERE e.symbol = d.symbol AND e.available_day <= d.session AND (
 (e.kind = 'EARNINGS' AND e.event_day >= d.session - 7 AND e.event_day <= d.hold_end) OR (e.kind = 'GUIDANCE_NEGATIVE' AND e.event_day >= d.session - 7 AND e.event_day <= d.session)
 OR (e.kind = 'HALT' AND e.event_day <= d.session AND coalesce(e.ended_day, DATE '9999-12-31') > d.session)))""")
def event_vetoes(spark, sf):
    from ..operators.crosssec import month_end_rows

    cal = P.calendar(spark, sf)
    ends = cal.select((F.col("pos") - 21).alias("pos"), F.col("session").alias("hold_end"))
    d = month_end_rows(P.placed(spark, sf), cal).select("symbol", "session", "pos").join(ends, "pos")
    return X.vetoed(d, P.announcements(spark, sf))


@query("FLT-09", "threshold #n_bars #n_vetoed", parts="rets", sql="""
SELECT kind || '_' || thr AS threshold, count(*) AS n_bars, sum(CASE WHEN CASE kind WHEN 'PCT' THEN abs(gap) ELSE abs(gap)/nullif(rng,0) END >= thr THEN 1 ELSE 0 END) AS n_vetoed
FROM (SELECT open_adj/px1-1 AS gap, (high_adj-low_adj)/px AS rng FROM rets WHERE px IS NOT NULL AND px1 IS NOT NULL) CROSS JOIN (VALUES ('PCT',0.03),('PCT',0.05),('PCT',0.1),('ATR',0.5),('ATR',1.0),('ATR',2.0)) t(kind,thr) GROUP BY kind, thr""")
def gap_vetoes(spark, sf):
    x = P.with_returns(spark, sf).where("px1 is not null").select(
        (F.col("open_adj") / F.col("px1") - 1).alias("gap"), ((F.col("high_adj") - F.col("low_adj")) / F.col("px")).alias("rng"))
    grid = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("thr"), F.lit(f"{k}_{n}").alias("threshold")) for k, t, n in (
        ("PCT", 0.03, "0.03"), ("PCT", 0.05, "0.05"), ("PCT", 0.1, "0.10"), ("ATR", 0.5, "0.50"), ("ATR", 1.0, "1.00"), ("ATR", 2.0, "2.00"))])
    x = x.select("*", F.inline(grid))
    score = F.when(F.col("kind") == "PCT", F.abs("gap")).otherwise(F.abs("gap") / F.nullif("rng", F.lit(0.0)))
    return x.groupBy("threshold").agg(F.count("*").alias("n_bars"), F.count_if(score >= F.col("thr")).alias("n_vetoed"))


part_kind = "CASE WHEN event_type IN ('view','click') THEN 'MINUTE' WHEN event_type = 'purchase' THEN 'TRADE' ELSE 'NBBO' END"


@query("FLT-10", "#event_id kind", sql=f"""
WITH e AS (SELECT event_id, user_id, {part_kind} AS kind, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events),
 m AS (SELECT *, hour(ny)*60+minute(ny) AS mi FROM e)
SELECT event_id, kind FROM m WHERE kind = 'MINUTE' AND mi BETWEEN 570 AND 960
UNION ALL SELECT event_id, kind FROM m WHERE kind <> 'MINUTE' AND mi BETWEEN 915 AND 965
 AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > (SELECT avg(value) FROM events))""")
def retained_intraday_rows(spark, sf):
    t = ticks(spark, sf).withColumn("kind", F.when(F.col("symbol").isin("view", "click"), "MINUTE").when(F.col("symbol") == "purchase", "TRADE").otherwise("NBBO"))
    level = t.agg(F.avg("price").alias("level"))
    finalists = t.groupBy("user_id").agg(F.avg("price").alias("m")).join(F.broadcast(level)).where("m > level")
    return X.retained_intraday(t.select("event_id", "user_id", "ts", "kind"), finalists, "user_id", "ts", "kind")


part_windows = """SELECT symbol, CAST(max(event_day) + 91 - 7 AS DATE) AS lo, CAST(max(event_day) + 91 + 7 AS DATE) AS hi FROM anns WHERE kind = 'EARNINGS' GROUP BY symbol"""


@query("FLT-11 FLT-12", "symbol session #weekday ~expected_bp verdict line", parts="rets anns", digits=3, sql=f"""
WITH w AS ({part_windows}), m AS (SELECT symbol, isodow(session)-1 AS weekday, round(avg(ret)*10000,3) AS bp FROM rets WHERE ret IS NOT NULL GROUP BY ALL),
 up AS (SELECT CAST(unnest(generate_series((SELECT max(session) FROM rets) + INTERVAL 1 DAY, (SELECT max(session) FROM rets) + INTERVAL 59 DAY, INTERVAL 1 DAY)) AS DATE) AS session)
SELECT m.symbol, up.session, m.weekday, m.bp AS expected_bp, CASE WHEN up.session BETWEEN w.lo AND w.hi THEN 'CAUTION_EARNINGS' WHEN m.bp >= 15 THEN 'GOOD' ELSE 'WAIT' END AS verdict,
 CASE WHEN m.bp >= 15 AND NOT coalesce(up.session BETWEEN w.lo AND w.hi, false) THEN m.symbol || ' ' || strftime(up.session, '%Y-%m-%d') END AS line
FROM m JOIN up ON isodow(up.session)-1 = m.weekday LEFT JOIN w ON w.symbol = m.symbol""")
def entry_verdicts(spark, sf):
    from ..operators.alerts import earnings_windows, entry_table, upcoming_days, weekday_expectation

    w = earnings_windows(P.announcements(spark, sf))
    return entry_table(weekday_expectation(P.with_returns(spark, sf)), upcoming_days(P.calendar(spark, sf), 59), w)


@query("FLT-14", "symbol session edge direction timer fired", digits=5, parts="ewm own", sql="""
WITH x AS (SELECT o.symbol, o.session, o.i, o.px, CASE WHEN e.i >= 3 THEN CASE WHEN e.d2 = 0 AND e.u2 > 0 THEN 100.0 WHEN e.d2 = 0 THEN 50.0 ELSE 100.0-100.0/(1.0+e.u2/e.d2) END END AS rsi2,
  max(o.px) OVER b AS high20, min(o.px) OVER b AS low20, CASE WHEN count(o.px) OVER g < 50 THEN 'UNKNOWN' WHEN o.px > round(avg(o.px) OVER g, 9) THEN 'UP' ELSE 'DOWN' END AS regime,
  CASE WHEN count(o.px) OVER f = 20 AND stddev_pop(o.px) OVER f > 2.5e-10 THEN (o.px - (avg(o.px) OVER f - 2*stddev_pop(o.px) OVER f)) / (4*stddev_pop(o.px) OVER f) END AS pct_b
 FROM own o JOIN ewm e ON e.symbol = o.symbol AND e.i = o.i WINDOW b AS (PARTITION BY o.symbol ORDER BY o.i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  f AS (PARTITION BY o.symbol ORDER BY o.i ROWS 19 PRECEDING), g AS (PARTITION BY o.symbol ORDER BY o.i ROWS 49 PRECEDING)),
 y AS (SELECT *, CASE WHEN edge = 'MOMENTUM' AND ((direction = 'LONG' AND regime = 'DOWN') OR (direction = 'SHORT' AND regime = 'UP')) THEN 'BLOCKED'
   WHEN edge = 'REVERSAL' THEN 'PULLBACK' WHEN edge = 'MOMENTUM' THEN 'BREAKOUT' ELSE 'IMMEDIATE' END AS timer
  FROM x CROSS JOIN (VALUES ('REVERSAL'),('MOMENTUM'),('CALENDAR')) t(edge) CROSS JOIN (VALUES ('LONG'),('SHORT')) d(direction))
SELECT symbol, session, edge, direction, timer, coalesce(CASE timer WHEN 'PULLBACK' THEN CASE direction WHEN 'LONG' THEN rsi2 < 10 OR pct_b < 0.2 ELSE rsi2 > 90 OR pct_b > 0.8 END
 WHEN 'BREAKOUT' THEN CASE direction WHEN 'LONG' THEN px >= high20 ELSE px <= low20 END WHEN 'IMMEDIATE' THEN true ELSE false END, false) AS fired FROM y""")
def entry_timers(spark, sf):
    own = W.partitionBy("symbol").orderBy("session")
    b, g = own.rowsBetween(-20, -1), own.rowsBetween(-49, 0)
    x = P.placed(spark, sf).select(
        "symbol", "session", "px", F.max("px").over(b).alias("high20"), F.min("px").over(b).alias("low20"),
        F.when(F.count("px").over(g) < 50, "UNKNOWN").when(F.col("px") > F.round(F.avg("px").over(g), 9), "UP").otherwise("DOWN").alias("regime"))
    x = x.join(recursive_indicators(spark, sf).select("symbol", "session", "rsi2"), ["symbol", "session"])
    x = x.join(bollinger_percent_b(spark, sf), ["symbol", "session"])
    sides = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(d).alias("direction")) for e in ("REVERSAL", "MOMENTUM", "CALENDAR") for d in ("LONG", "SHORT")])
    return X.timer_columns(x.select("*", F.inline(sides)))


@query("FLT-15", "anchor #n ~mean_value", sql="""
SELECT CASE WHEN m < 570 THEN 'PRE_OPEN' WHEN m < 600 THEN 'OPEN' WHEN m < 930 THEN 'MIDDAY' WHEN m < 960 THEN 'CLOSE' ELSE 'AFTER_HOURS' END AS anchor, count(*) AS n, avg(value) AS mean_value
FROM (SELECT value, hour(ny)*60+minute(ny) AS m FROM (SELECT value, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events)) GROUP BY 1""")
def time_of_day_class(spark, sf):
    t = ticks(spark, sf).withColumn("anchor", X.time_class(clock.clock_minutes("ts")))
    return t.groupBy("anchor").agg(F.count("*").alias("n"), F.avg("price").alias("mean_value"))


@query("FLT-16", "symbol session #context_id", parts="bars anns", sql="""
SELECT b.symbol, b.session, max_by(a.event_id, (a.available_day, a.event_id)) AS context_id FROM bars b JOIN anns a ON a.symbol = b.symbol AND a.kind = 'OTHER'
 AND a.available_day <= b.session AND b.session < a.available_day + 10 GROUP BY b.symbol, b.session""")
def valid_operator_context(spark, sf):
    a = P.announcements(spark, sf).where("kind = 'OTHER'").groupBy("symbol", F.col("available_day").alias("start")).agg(
        F.max("event_id").alias("event_id")).withColumn("end", F.date_add("start", 10))
    x = M.during(P.bars(spark, sf).select("symbol", "session"), a)
    return x.groupBy("symbol", "session").agg(F.max_by("event_id", F.struct("start", "event_id")).alias("context_id"))


@query("FLT-17", "capability status #missing", parts="members bars anns", sql="""
SELECT 'MEMBERSHIP' AS capability, CASE WHEN count(*) = 0 THEN 'DATA_UNAVAILABLE' WHEN count(*) FILTER (t.symbol IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (t.symbol IS NULL) AS missing
FROM (SELECT DISTINCT symbol FROM members) m LEFT JOIN (SELECT DISTINCT symbol FROM bars) t ON t.symbol = m.symbol
UNION ALL SELECT 'AUCTION_COVERAGE', CASE WHEN count(*) = 0 THEN 'DATA_UNAVAILABLE' WHEN count(*) FILTER (coalesce(k,0) < 2) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FILTER (coalesce(k,0) < 2)
FROM (SELECT DISTINCT symbol FROM members) m LEFT JOIN (SELECT symbol, count(DISTINCT kind) AS k FROM anns WHERE kind IN ('EARNINGS','HALT') GROUP BY symbol) a ON a.symbol = m.symbol""")
def data_capability_gates(spark, sf):
    return X.capability_gates(P.memberships(spark, sf), P.bars(spark, sf), P.announcements(spark, sf), ["EARNINGS", "HALT"])
