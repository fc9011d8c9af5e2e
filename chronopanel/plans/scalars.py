"""Calendar tables and scalar functions."""

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part


@query("WIN-36 FUN-07", "session #weekday #month #session_of_month #to_month_end #to_quarter_end month_end_window quarter_end_window turn_of_month",
       parts="flags", sql="SELECT * FROM flags")
def calendar_positions(spark, sf):
    return C.flags(P.calendar(spark, sf))


@query("ASM-01 WIN-38 WIN-39 WIN-40", "session #weekday #month turn_of_month month_end_window quarter_end_window pre_holiday post_holiday event_day_before event_day_of event_week opex_week",
       parts="flags", sql="SELECT * FROM flags")
def calendar_feature_table(spark, sf):
    return P.calendar_table(spark, sf)


@query("WIN-37", "symbol session tom", parts="bars", sql="""
SELECT symbol, session, bool_or(b) OVER (PARTITION BY symbol ORDER BY session ROWS 3 PRECEDING) AS tom FROM (
SELECT symbol, session, coalesce(date_trunc('month', lead(session) OVER (PARTITION BY symbol ORDER BY session)) <> date_trunc('month', session), false) AS b FROM bars)""")
def observed_turn_of_month(spark, sf):
    """Each symbol's own sessions are a calendar with irregular closures."""
    return C.observed_turn_of_month(P.bars(spark, sf).select("symbol", "session"), by=("symbol",))


@query("WIN-38", "session pre_holiday pre post", parts="venue", sql="""
SELECT session, coalesce(lead(session) OVER w > session + CASE WHEN isodow(session)=5 THEN 3 ELSE 1 END, false) AS pre_holiday,
 coalesce(lead(session) OVER w > session + CASE WHEN isodow(session)=5 THEN 3 ELSE 1 END, false) AS pre,
 coalesce(session > lag(session) OVER w + CASE WHEN isodow(lag(session) OVER w)=5 THEN 3 ELSE 1 END, false) AS post
FROM venue WINDOW w AS (ORDER BY session)""")
def closures_next_to_sessions(spark, sf):
    cal = P.venue_calendar(spark, sf)
    gaps = C.gap_before_next(cal).select("session", "pre_holiday")
    closed = C.civil(cal, 0).where("session is null and weekday(day) < 5").select("day")
    near = C.near_days(cal, closed, "day").select("session", F.col("day_before").alias("pre"), F.col("day_after").alias("post"))
    return gaps.join(near, "session")


@query("WIN-40", "session opex_week opex_day", parts="venue", sql="""
WITH tf AS (SELECT CAST(m + INTERVAL (((5 - isodow(m) + 7) % 7) + 14) DAY AS DATE) AS nominal FROM (SELECT DISTINCT date_trunc('month', session) AS m FROM venue)),
 ex AS (SELECT (SELECT max(session) FROM venue v WHERE v.session <= nominal) AS expiry FROM tf)
SELECT session, session + CAST((5 - isodow(session) + 7) % 7 AS INTEGER) IN (SELECT expiry + CAST((5 - isodow(expiry) + 7) % 7 AS INTEGER) FROM ex WHERE expiry IS NOT NULL) AS opex_week,
 session IN (SELECT expiry FROM ex WHERE expiry IS NOT NULL) AS opex_day FROM venue""")
def shifted_expiry_weeks(spark, sf):
    return C.shifted_opex(P.venue_calendar(spark, sf))


@query("FUN-20", "day is_session previous next #sessions_so_far", parts="venue", sql="""
SELECT CAST(day AS DATE) AS day, EXISTS (SELECT 1 FROM venue WHERE session = day) AS is_session,
 (SELECT max(session) FROM venue WHERE session < day) AS previous, (SELECT min(session) FROM venue WHERE session > day) AS next,
 (SELECT count(*) FROM venue WHERE session <= day) AS sessions_so_far
FROM (SELECT unnest(generate_series((SELECT min(session) FROM venue), (SELECT max(session) FROM venue), INTERVAL 1 DAY)) AS day)""")
def trading_day_count(spark, sf):
    cal = P.venue_calendar(spark, sf)
    numbered = cal.select(F.col("session").alias("on_or_before"), F.col("pos").alias("sessions_so_far"))
    return C.civil(cal, 0).join(numbered, "on_or_before").select(
        "day", F.col("session").isNotNull().alias("is_session"), F.col("before").alias("previous"), F.col("after").alias("next"), "sessions_so_far")


from ..functions import clock  # noqa: E402
from ..functions import costs as K  # noqa: E402
from ..functions import scalar as SC  # noqa: E402
from ..operators import sizing as SZ  # noqa: E402
from ..operators.trials import identity, seed_of  # noqa: E402
from .windows import recursive_indicators, stop_and_gap_risk  # noqa: E402


@query("FUN-01", "symbol session id", parts="bars", sql="""
SELECT symbol, session, 'BAR-' || substring(sha256('{"asset_type":"' || asset_type || '","session":"' || strftime(session,'%Y-%m-%d') || '","symbol":"' || symbol || '"}'),1,16) AS id FROM bars""")
def canonical_identities(spark, sf):
    payload = F.struct("asset_type", F.date_format("session", "yyyy-MM-dd").alias("session"), "symbol")
    return P.bars(spark, sf).withColumn("id", identity(payload, F.lit("BAR")))


@query("FUN-02", "#o_custkey seed", sql="""
SELECT o_custkey, CAST(CAST('0x' || substring(h,15,2) || substring(h,13,2) || substring(h,11,2) || substring(h,9,2) || substring(h,7,2) || substring(h,5,2) || substring(h,3,2) || substring(h,1,2) AS UBIGINT) AS VARCHAR) AS seed FROM (SELECT c_custkey AS o_custkey, sha256('42:' || c_custkey || ':SHUFFLE') AS h FROM customer)""")
def stable_seeds(spark, sf):
    seed = seed_of(F.lit("42"), F.col("c_custkey").cast("string"), F.lit("SHUFFLE")).cast("string")
    return P.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), seed.alias("seed"))


@query("FUN-03", "name vendor canonical digits", sql="""
SELECT s_name AS name, replace(lower(s_name), '#', '.') AS vendor, regexp_replace(upper(replace(lower(s_name), '#', '.')), '[./ ]', '-', 'g') AS canonical, regexp_extract(s_name, '([0-9]+)', 1) AS digits FROM supplier""")
def symbol_mapping(spark, sf):
    v = F.replace(F.lower("s_name"), F.lit("#"), F.lit("."))
    return P.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), v.alias("vendor"), SC.canonical_symbol(v).alias("canonical"), SC.digits(F.col("s_name")).alias("digits"))


@query("FUN-04", "#o_orderkey d ~number", sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice AS number FROM orders")
def tolerant_parsing(spark, sf):
    kind = F.pmod("o_orderkey", F.lit(3))
    day = F.to_date("o_orderdate")
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    number = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2))
    return P.table(spark, sf, "orders").select("o_orderkey", SC.tolerant_date(text).alias("d"), SC.tolerant_number(number).alias("number"))


@query("FUN-05 SRC-17", "session release latest_before report_release", parts="cal", sql="""
SELECT session, strftime(timezone('UTC', timezone('America/New_York', w + INTERVAL '10 hours 30 minutes')), '%Y-%m-%d %H:%M:%S') AS release,
 CASE WHEN isodow(session) > 3 THEN w - 7 WHEN isodow(session) = 3 THEN w ELSE w - 7 END AS latest_before, strftime(timezone('UTC', timezone('America/New_York', t + 3 + INTERVAL '15 hours 30 minutes')), '%Y-%m-%d %H:%M:%S') AS report_release
FROM (SELECT session, CAST(session + CAST((3 - isodow(session) + 7) % 7 AS INTEGER) AS DATE) AS w, CAST(session - CAST((isodow(session) - 2 + 7) % 7 AS INTEGER) AS DATE) AS t FROM cal)""")
def release_calendar(spark, sf):
    return SC.release_times(P.calendar(spark, sf))


@query("FUN-06", "session exit_session crosses_weekend in_release_window", parts="cal", sql="""
SELECT a.session, b.session AS exit_session, date_trunc('week', a.session) <> date_trunc('week', b.session) AS crosses_weekend, isodow(a.session) = 3 OR (isodow(a.session) < 3 AND isodow(b.session) >= 3 AND date_trunc('week', a.session) = date_trunc('week', b.session)) OR (date_trunc('week', b.session) > date_trunc('week', a.session) AND (isodow(b.session) >= 3 OR isodow(a.session) <= 3)) AS in_release_window
FROM cal a JOIN cal b ON b.pos = a.pos + 3""")
def weekend_and_release_flags(spark, sf):
    ends = P.calendar(spark, sf).select((F.col("pos") - 3).alias("pos"), F.col("session").alias("exit_session"))
    return SC.holding_flags(P.calendar(spark, sf).join(ends, "pos"))


@query("FUN-08 ASM-13", "symbol session ~cost_bps ~short_cost_bps", parts="rets", sql="""
SELECT symbol, session, sp + 2*im + 1 AS cost_bps, sp + 2*im + 1 + 0.003*10000/365*5 AS short_cost_bps FROM (
SELECT symbol, session, px, CASE WHEN asset_type='etf' THEN 1.0 ELSE 3.0 END AS sp, least(1+10*sqrt(10000.0/coalesce(avg(px*volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),1e8)),50) AS im FROM rets) WHERE px IS NOT NULL""")
def trade_cost(spark, sf):
    from .inference import market

    o = F.lit(10_000.0)
    return market(spark, sf).select(
        "symbol", "session", K.trade_bps(o, F.col("adv20"), F.col("asset_type")).alias("cost_bps"),
        K.trade_bps(o, F.col("adv20"), F.col("asset_type"), 2, F.lit(5.0), F.lit(True)).alias("short_cost_bps"))


@query("FUN-10", "#vec_id #other ~similarity", digits=5, sql="""
SELECT vec_id, other, (CASE WHEN label = l2 THEN 1.0 ELSE 0.0 END + dot/nullif(sqrt(n1*n2),0) + (n*dot-s1*s2)/nullif(sqrt((n*n1-s1*s1)*(n*n2-s2*s2)),0))/3 AS similarity FROM (SELECT a.vec_id, b.vec_id AS other, a.label, b.label AS l2, len(a.embedding) AS n,
 list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))) AS s1, list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))) AS s2,
 list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE)*CAST(x[2] AS DOUBLE))) AS dot, list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE))) AS n1, list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)*CAST(x AS DOUBLE))) AS n2
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def trade_similarity(spark, sf):
    """Each vector with the next: correlation of its components, same label, cosine."""
    e = P.table(spark, sf, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"), F.col("label").alias("l2"))
    x = e.join(other, "vec_id")
    return x.withColumn("similarity", SC.similarity(SC.correlation(F.col("embedding"), F.col("e2")), F.col("label") == F.col("l2"), F.col("embedding"), F.col("e2")))


@query("FUN-11 ASM-08", "symbol #shares", digits=5, parts="ewm own", sql="""
SELECT symbol, floor(least(100000.0*0.005/(2*atr), 100000.0*0.1/px, adv*0.01)) AS shares FROM (SELECT e.symbol, e.atr, o.px, avg(o.volume) OVER (PARTITION BY e.symbol ORDER BY e.i ROWS 19 PRECEDING) AS adv, e.i, max(e.i) OVER (PARTITION BY e.symbol) AS n FROM ewm e JOIN own o ON o.symbol = e.symbol AND o.i = e.i) WHERE i = n""")
def position_sizes(spark, sf):
    from pyspark.sql import Window as W

    from ..operators.advisor import latest

    w = W.partitionBy("symbol").orderBy("session").rowsBetween(-19, 0)
    x = latest(P.placed(spark, sf).withColumn("adv_shares", F.avg("volume").over(w)).select("symbol", "session", "px", "adv_shares"))
    return x.join(stop_and_gap_risk(spark, sf), "symbol").withColumn("shares", SZ.shares(F.lit(100_000.0), F.col("px"), 2 * F.col("atr14"), F.col("adv_shares")))


@query("FUN-12", "symbol session exit_session", parts="bars cal", sql="SELECT b.symbol, b.session, d.session AS exit_session FROM bars b JOIN cal c ON c.session = b.session JOIN cal d ON d.pos = c.pos + 5")
def time_exits(spark, sf):
    ends = P.calendar(spark, sf).select((F.col("pos") - 5).alias("pos"), F.col("session").alias("exit_session"))
    return P.placed(spark, sf).join(ends, "pos")


@query("FUN-13", "symbol session ~long_stop ~short_stop", parts="own", sql="""
SELECT symbol, session, least(p1*0.95, open_adj)/p1 - 1 - 0.0008 AS long_stop, -(greatest(p1*1.05, open_adj)/p1 - 1) - 0.0008 AS short_stop FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY i) AS p1 FROM own) WHERE p1 IS NOT NULL""")
def gap_adjusted_stops(spark, sf):
    from pyspark.sql import Window as W

    x = P.placed(spark, sf).withColumn("p1", F.lag("px").over(W.partitionBy("symbol").orderBy("session"))).where("p1 is not null")
    return x.select("symbol", "session", SZ.stop_return(F.col("p1"), F.col("p1") * 0.95, F.col("open_adj"), "LONG", 8.0).alias("long_stop"),
                    SZ.stop_return(F.col("p1"), F.col("p1") * 1.05, F.col("open_adj"), "SHORT", 8.0).alias("short_stop"))


part("lanes", "own stop_gaps", """
SELECT symbol, lane, leverage, notional, notional*stressed AS planned_loss, CASE WHEN leverage = 0 THEN 'NO_LEVERAGE' WHEN notional*0.001 + notional/px*0.05 > notional*stressed*0.1 THEN 'COST_TOO_HIGH' ELSE 'READY' END AS status FROM (
SELECT *, CASE WHEN notional <= 100000 AND stressed*10 < 1 THEN 10 WHEN notional <= 50000 AND stressed*5 < 1 THEN 5 WHEN notional <= 20000 AND stressed*2 < 1 THEN 2 WHEN notional <= 10000 AND stressed < 1 THEN 1 ELSE 0 END AS leverage FROM (
SELECT symbol, px, lane, stressed, least(10000*risk/stressed, 100000) AS notional FROM (SELECT o.symbol, o.px, 2*g.atr14/o.px + g.gap_p99 AS stressed FROM own o JOIN stop_gaps g USING (symbol) QUALIFY row_number() OVER (PARTITION BY o.symbol ORDER BY o.i DESC) = 1)
CROSS JOIN (VALUES ('core',0.005),('standard',0.01),('elevated',0.02),('challenge_5',0.05),('challenge_10',0.1)) t(lane, risk)))""")


@query("FUN-14 PRT-17", "symbol lane status #leverage ~notional ~planned_loss", digits=4, parts="lanes", sql="SELECT * FROM lanes")
def risk_lanes(spark, sf):
    from ..operators.advisor import latest

    x = latest(P.placed(spark, sf)).select("symbol", "px", "sector").join(stop_and_gap_risk(spark, sf).select("symbol", "atr14", "gap_p99"), "symbol")
    return SZ.risk_lanes(x, 10_000.0)


@query("FUN-15", "symbol ~mean ~shrunk", digits=7, parts="rets", sql="""
SELECT symbol, m AS mean, CASE WHEN abs(t) > 1 THEN m*(1-1/(t*t)) ELSE 0.0 END AS shrunk FROM (SELECT symbol, avg(ret) AS m, avg(ret)/(stddev_samp(ret)/sqrt(count(ret))) AS t FROM rets GROUP BY symbol)""")
def positive_part_shrinkage(spark, sf):
    from ..operators.conditions import shrunk_mean

    x = P.with_returns(spark, sf).groupBy("symbol").agg(F.avg("ret").alias("mean"), (F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("ret")))).alias("t"))
    return x.withColumn("shrunk", shrunk_mean(F.col("mean"), F.col("t")))


@query("FUN-16", "#event_id #confidence", sql="SELECT event_id, round_even(100*round((value/(1+value))*0.5, 6), 0) AS confidence FROM events")
def ordinal_confidence(spark, sf):
    v = F.round(F.col("value") / (1 + F.col("value")) * 0.5, 6)
    return P.table(spark, sf, "events").select("event_id", F.bround(F.lit(100.0) * v, 0).alias("confidence"))


@query("ASM-03", "symbol session event_time available", parts="bars", sql="""
SELECT symbol, session, strftime(timezone('UTC', timezone('America/New_York', session + INTERVAL 16 HOUR)), '%Y-%m-%d %H:%M:%S') AS event_time, strftime(timezone('UTC', timezone('America/New_York', session + INTERVAL '16 hours 15 minutes')), '%Y-%m-%d %H:%M:%S') AS available FROM bars""")
def daily_times(spark, sf):
    return P.bars(spark, sf).select("symbol", "session", clock.stamp(clock.market_close("session")).alias("event_time"), clock.stamp(clock.bar_available("session")).alias("available"))


@query("ASM-05 ASM-07", "symbol session ~close ~close_ret ~overnight_ret ~intraday_ret", parts="rets", sql="SELECT symbol, session, px AS close, ret AS close_ret, open_adj/px1-1 AS overnight_ret, px/open_adj-1 AS intraday_ret FROM rets WHERE px IS NOT NULL")
def benchmark_legs(spark, sf):
    """The close of every symbol on its sessions and its return in each session convention, so any of them can be the benchmark."""
    return P.with_returns(spark, sf).select("symbol", "session", F.col("px").alias("close"), F.col("ret").alias("close_ret"), (F.col("open_adj") / F.col("px1") - 1).alias("overnight_ret"), (F.col("px") / F.col("open_adj") - 1).alias("intraday_ret"))


@query("ASM-14", "#event_id stale", sql="SELECT event_id, ts < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 36 HOUR AS stale FROM events")
def stale_snapshots(spark, sf):
    now = F.lit("2024-01-29 00:00:00").cast("timestamp")
    return P.table(spark, sf, "events").select("event_id", (F.col("ts").cast("timestamp") < now - F.expr("INTERVAL 36 HOURS")).alias("stale"))


@query("ASM-09", "symbol weekday_best guidance", parts="rets", sql="""
SELECT symbol, arg_max(d, (m, d)) AS weekday_best, CASE WHEN max(m) > 0.002 THEN 'HOLD_TO_' || arg_max(d, (m, d)) ELSE 'NO_EDGE' END AS guidance FROM (SELECT symbol, CAST(isodow(session)-1 AS VARCHAR) AS d, round(avg(ret),9) AS m FROM rets WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 30) GROUP BY symbol""")
def exit_guidance(spark, sf):
    from ..operators.signals import window_means

    m = window_means(P.with_returns(spark, sf), 30).where("kind = 'WEEKDAY'").groupBy("symbol").agg(F.max_by("label", F.struct("mean", "label")).alias("weekday_best"), F.max("mean").alias("m"))
    return m.withColumn("guidance", F.when(F.col("m") > 0.002, F.concat(F.lit("HOLD_TO_"), "weekday_best")).otherwise("NO_EDGE"))
