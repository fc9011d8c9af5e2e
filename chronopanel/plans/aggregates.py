"""Aggregates over streams, panels, cohorts and ledgers."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import costs as K
from ..operators import features as FE
from ..operators import inference as I
from ..operators import performance as PF
from ..operators import risk as RK
from ..operators import streams as S
from ..operators.alerts import earnings_windows
from ..sources import panel as P
from .catalog import query
from .inference import market, market_regime, signals, streams
from .joins import fills_with_exits, ledger
from .oracle_parts import part


@query("AGG-02 AGG-03", "symbol session ~mkt ~sector_mean ~peer", parts="peers mkt", sql="""
SELECT p.symbol, p.session, m.mkt, avg(p.ret) OVER (PARTITION BY p.session, p.sector) AS sector_mean, p.peer FROM peers p JOIN mkt m ON m.pos = p.pos QUALIFY px IS NOT NULL""")
def market_and_sector_means(spark, sf):
    r = P.with_returns(spark, sf)
    x = FE.leave_one_out(r).withColumn("sector_mean", F.avg("ret").over(W.partitionBy("session", "sector")))
    return x.join(FE.market_return(r).select("pos", "mkt"), "pos")


@query("AGG-05 AGG-06 PRT-20", "trial ~total ~cagr ~vol ~sortino ~max_drawdown ~beta ~alpha ~info ~corr", digits=4, parts="streams mkt", sql="""
WITH x AS (SELECT s.trial, s.pos, s.net AS r, coalesce(m.mkt,0) AS b FROM streams s JOIN mkt m ON m.pos = s.pos), e AS (SELECT trial, pos, exp(sum(ln(1+r)) OVER (PARTITION BY trial ORDER BY pos)) AS eq FROM x),
 d AS (SELECT trial, min(eq/greatest(1.0,pk)-1) AS max_drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY trial ORDER BY pos) AS pk FROM e) GROUP BY trial)
SELECT trial, exp(sum(ln(1+r)))-1 AS total, exp(sum(ln(1+r))*252/count(*))-1 AS cagr, stddev_samp(r)*sqrt(252.0) AS vol, avg(r)*sqrt(252.0)/nullif(sqrt(avg(power(least(r,0),2))),0) AS sortino, any_value(max_drawdown) AS max_drawdown,
 covar_samp(r,b)/var_samp(b) AS beta, (avg(r)-covar_samp(r,b)/var_samp(b)*avg(b))*252 AS alpha, avg(r-b)/stddev_samp(r-b)*sqrt(252.0) AS info, CASE WHEN stddev_samp(r) > 0 THEN corr(r,b) END AS corr FROM x JOIN d USING (trial) GROUP BY trial""")
def performance_set(spark, sf):
    m = FE.market_return(P.with_returns(spark, sf)).select("pos", F.coalesce("mkt", F.lit(0.0)).alias("bench"))
    return PF.performance(streams(spark, sf).join(m, "pos"), "net", "bench")


@query("AGG-07", "trial ~turnover ~exposure", parts="streams", sql="SELECT trial, avg(turnover) AS turnover, avg(CASE WHEN exposure > 1e-12 THEN 1.0 ELSE 0.0 END) AS exposure FROM streams GROUP BY trial")
def mean_turnover(spark, sf):
    return streams(spark, sf).groupBy("trial").agg(F.avg("turnover").alias("turnover"), F.avg((F.col("exposure") > 1e-12).cast("double")).alias("exposure"))


@query("AGG-08 VAL-13", "symbol #n_event ~event_mean ~rest_mean ~difference ~t", digits=5, parts="rets flags", sql="""
WITH x AS (SELECT r.symbol, r.pos, r.ret AS v, f.turn_of_month AS f FROM rets r JOIN flags f ON f.pos = r.pos WHERE r.ret IS NOT NULL),
 s AS (SELECT symbol, avg(v) FILTER (f) AS em, avg(v) FILTER (NOT f) AS rm, avg(CAST(f AS DOUBLE)) AS sh, count(*) FILTER (f) AS ne, count(*) AS n FROM x GROUP BY symbol),
 i AS (SELECT x.symbol, row_number() OVER (PARTITION BY x.symbol ORDER BY pos) AS k, n, CASE WHEN f THEN (v-em)/sh ELSE -(v-rm)/(1-sh) END AS c FROM x JOIN s USING (symbol)),
 g AS (SELECT a.symbol, l.k, sum(a.c*b.c) AS g FROM i a JOIN (SELECT unnest(generate_series(0,12)) AS k) l ON l.k <= floor(4*power(a.n/100.0,2.0/9.0)) JOIN i b ON b.symbol = a.symbol AND b.k = a.k - l.k GROUP BY a.symbol, l.k)
SELECT s.symbol, any_value(ne) AS n_event, any_value(em) AS event_mean, any_value(rm) AS rest_mean, any_value(em-rm) AS difference,
 any_value(em-rm)/(sqrt(sum(CASE WHEN k = 0 THEN g ELSE 2*(1-k/(floor(4*power(n/100.0,2.0/9.0))+1))*g END))/any_value(n)) AS t FROM s JOIN g ON g.symbol = s.symbol GROUP BY s.symbol""")
def event_mean_difference(spark, sf):
    x = P.with_returns(spark, sf).join(P.calendar_table(spark, sf).select("pos", "turn_of_month"), "pos")
    return I.event_difference(x, ["symbol"], "pos", "ret", "turn_of_month")


@query("AGG-12", "symbol #n ~p_loss ~es ~q10 ~worst ~mean", parts="rets", sql="""
SELECT symbol, count(*) AS n, avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END) AS p_loss, avg(ret) FILTER (ret <= q) AS es, quantile_cont(ret, 0.1) AS q10, min(ret) AS worst, avg(ret) AS mean
FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM rets WHERE ret IS NOT NULL) GROUP BY symbol""")
def cohort_loss_profile(spark, sf):
    return RK.loss_profile(P.with_returns(spark, sf), "symbol", "ret")


@query("AGG-13", "symbol #n_runs #longest ~median_length ~p90_length", parts="rets", sql="""
SELECT symbol, count(*) AS n_runs, max(c) AS longest, quantile_cont(c,0.5) AS median_length, quantile_cont(c,0.9) AS p90_length FROM (SELECT symbol, g, count(*) AS c FROM (
SELECT symbol, i - row_number() OVER (PARTITION BY symbol ORDER BY pos) AS g FROM (SELECT symbol, pos, ret, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS i FROM rets WHERE ret IS NOT NULL) WHERE ret < 0) GROUP BY symbol, g) GROUP BY symbol""")
def losing_streaks(spark, sf):
    return RK.run_lengths(P.with_returns(spark, sf).where("ret is not null"), "symbol", "pos", F.col("ret") < 0)


@query("AGG-14 JOIN-08", "status #n ~mean_ret ~win_rate ~worst ~best", parts="ledger", sql="""
WITH f AS (SELECT rec, arg_min(price, (ts, event_id)) AS fill, min(ts) AS at FROM ledger WHERE event = 'FILL' GROUP BY rec),
 x AS (SELECT f.rec, arg_min(price, (ts, event_id)) AS e FROM f JOIN ledger l ON l.rec = f.rec AND l.event = 'EXIT' AND l.ts > f.at GROUP BY f.rec)
SELECT CASE WHEN x.rec IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, count(*) AS n, avg(e/fill-1) AS mean_ret, avg(CASE WHEN e > fill THEN 1.0 WHEN e IS NOT NULL THEN 0.0 END) AS win_rate, min(e/fill-1) AS worst, max(e/fill-1) AS best FROM f LEFT JOIN x ON x.rec = f.rec GROUP BY 1""")
def ledger_scorecard(spark, sf):
    return fills_with_exits(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.avg((F.col("exit_price") > F.col("fill")).cast("double")).alias("win_rate"), F.min("ret").alias("worst"), F.max("ret").alias("best"))


@query("AGG-17", "trial #year ~annual", digits=5, parts="streams", sql="SELECT trial, year(session) AS year, exp(sum(ln(1+net)))-1 AS annual FROM streams GROUP BY ALL")
def annual_returns(spark, sf):
    return streams(spark, sf).groupBy("trial", F.year("session").alias("year")).agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("annual"))


@query("AGG-17", "trial #years ~positive_fraction", parts="streams", sql="SELECT trial, count(*) AS years, avg(CASE WHEN a > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive_fraction FROM (SELECT trial, exp(sum(ln(1+net)))-1 AS a FROM streams GROUP BY trial, year(session)) GROUP BY trial")
def positive_year_fraction(spark, sf):
    return annual_returns(spark, sf).groupBy("trial").agg(F.count("*").alias("years"), F.avg((F.col("annual") > 1e-12).cast("double")).alias("positive_fraction"))


@query("AGG-18", "symbol era #n ~mean ~hit", parts="rets", sql="""
SELECT symbol, era, count(*) AS n, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM rets JOIN (VALUES ('EARLY', DATE '1995-01-01', DATE '1997-01-01'),('MIDDLE', DATE '1997-01-01', DATE '1999-07-01'),('LATE', DATE '1999-07-01', DATE '2002-01-01')) e(era,a,b)
ON session >= a AND session < b WHERE ret IS NOT NULL GROUP BY ALL""")
def era_means(spark, sf):
    return PF.eras(P.with_returns(spark, sf))


@query("AGG-20", "trial kind regime #n ~mean", parts="streams mkt flags", sql="""
WITH r AS (SELECT pos, coalesce(lag(lvl > avg20) OVER (ORDER BY pos), false) AS on_, lag(avg20) OVER (ORDER BY pos) AS a FROM (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(lvl) OVER w END AS avg20 FROM (SELECT pos, round(sum(coalesce(mkt,0)) OVER (ORDER BY pos), 9) AS lvl FROM mkt) WINDOW w AS (ORDER BY pos ROWS 19 PRECEDING)))
SELECT trial, kind, regime, count(*) AS n, avg(net) AS mean FROM (SELECT s.trial, s.net, 'TREND' AS kind, CASE WHEN on_ THEN 'UP' ELSE 'DOWN' END AS regime FROM streams s JOIN r ON r.pos = s.pos WHERE a IS NOT NULL
UNION ALL SELECT s.trial, s.net, 'TURN', CASE WHEN turn_of_month THEN 'TOM' ELSE 'REST' END FROM streams s JOIN flags f ON f.pos = s.pos) GROUP BY ALL""")
def regime_stratification(spark, sf):
    trend = market_regime(spark, sf).select("pos", F.lit("TREND").alias("kind"), F.when(F.col("on"), "UP").otherwise("DOWN").alias("regime"))
    turn = P.calendar_table(spark, sf).select("pos", F.lit("TURN").alias("kind"), F.when(F.col("turn_of_month"), "TOM").otherwise("REST").alias("regime"))
    return I.hac(streams(spark, sf).join(trend.unionByName(turn), "pos"), ["trial", "kind", "regime"], "pos", "net")


@query("AGG-21", "direction #percent ~magnitude", parts="rets", sql="""
SELECT direction, p AS percent, q[CAST(p+1 AS INTEGER)] AS magnitude FROM (SELECT CASE WHEN ret > 0 THEN 'UP' ELSE 'DOWN' END AS direction, quantile_cont(abs(ret), (SELECT list(x/100.0 ORDER BY x) FROM (SELECT unnest(generate_series(0,100)) AS x))) AS q FROM rets WHERE ret <> 0 GROUP BY 1), (SELECT unnest(generate_series(0,100)) AS p)""".replace("(SELECT list(x/100.0 ORDER BY x) FROM (SELECT unnest(generate_series(0,100)) AS x))", "[" + ",".join(f"{i / 100:.2f}" for i in range(101)) + "]"))
def magnitude_percentiles(spark, sf):
    return PF.magnitude_table(P.with_returns(spark, sf), "ret")


@query("AGG-22 VAL-13", "symbol ~overnight ~intraday ~share", digits=5, parts="rets", sql="""
SELECT symbol, o AS overnight, i AS intraday, o/nullif(o+i,0) AS share FROM (SELECT symbol, sum(ln(open_adj/px1)) AS o, sum(ln(px/open_adj)) AS i FROM rets WHERE px1 IS NOT NULL AND px IS NOT NULL GROUP BY symbol)""")
def overnight_dominance(spark, sf):
    x = P.with_returns(spark, sf).where("px1 is not null").groupBy("symbol").agg(
        F.sum(F.ln(F.col("open_adj") / F.col("px1"))).alias("overnight"), F.sum(F.ln(F.col("px") / F.col("open_adj"))).alias("intraday"))
    return x.withColumn("share", F.col("overnight") / F.nullif(F.col("overnight") + F.col("intraday"), F.lit(0.0)))


@query("AGG-23", "sector #peers #healing", parts="own", sql="""
SELECT sector, count(*) AS peers, count(*) FILTER (r5 > 0 AND px > m20) AS healing FROM (SELECT symbol, sector, i, px, px/lag(px,5) OVER w - 1 AS r5, CASE WHEN count(px) OVER f = 20 THEN avg(px) OVER f END AS m20 FROM own
WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1) GROUP BY sector""")
def peer_breadth(spark, sf):
    return PF.healing_peers(P.placed(spark, sf))


@query("AGG-24", "symbol ~gap expected", parts="anns", sql="""
SELECT symbol, gap, CAST(last + CAST(floor(gap) AS INTEGER) AS DATE) AS expected FROM (SELECT symbol, max(event_day) AS last, coalesce(quantile_cont(g,0.5) FILTER (g BETWEEN 60 AND 130), 91) AS gap FROM (
SELECT symbol, event_day, event_day - lag(event_day) OVER (PARTITION BY symbol ORDER BY event_day) AS g FROM (SELECT DISTINCT symbol, event_day FROM anns WHERE kind = 'EARNINGS')) GROUP BY symbol)""")
def expected_announcements(spark, sf):
    return earnings_windows(P.announcements(spark, sf), None)


@query("AGG-25", "trial kind ~factor ~net", digits=5, parts="cube streams", sql="""
WITH base AS (SELECT trial, avg(gross) AS g, avg(cost) AS c FROM streams GROUP BY trial), cap AS (
 SELECT trial, f, sum((abs(weight-previous)*(CASE WHEN asset_type='etf' THEN 1.0 ELSE 3.0 END/2 + least(1.0+10.0*sqrt(abs(weight-previous)*100000.0*f/adv),50.0) + 1.0) + greatest(-weight,0)*0.003/365.0*10000.0)/10000.0)/(SELECT count(*) FROM cal) AS c FROM cube CROSS JOIN (VALUES (1.0),(10.0),(100.0),(1000.0)) t(f) GROUP BY ALL)
SELECT trial, 'COST' AS kind, f AS factor, g - c*f AS net FROM base CROSS JOIN (VALUES (0.5),(1.0),(2.0),(4.0)) t(f) UNION ALL SELECT trial, 'CAPACITY', f, g - cap.c FROM base JOIN cap USING (trial)""")
def cost_sensitivity_and_capacity(spark, sf):
    pos = S.positions(S.reversal_entries(signals(spark, sf)), 5, 2)
    return PF.sensitivity(streams(spark, sf), pos, market(spark, sf), P.calendar(spark, sf))


@query("AGG-27", "symbol state #n ~liquidated ~median_levered ~p95_excursion", digits=5, parts="rets", sql="""
SELECT symbol, state, count(*) AS n, avg(CASE WHEN exc >= 0.5 THEN 1.0 ELSE 0.0 END) AS liquidated, quantile_cont(CASE WHEN exc >= 0.5 THEN -1.0 ELSE 2*(ex/en-1) END, 0.5) AS median_levered, quantile_cont(exc,0.95) AS p95_excursion FROM (
SELECT symbol, CASE WHEN ret < 0 THEN 'DOWN' ELSE 'UP' END AS state, lead(px,1) OVER w AS en, lead(px,6) OVER w AS ex, 1 - min(low_adj) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)/lead(px,1) OVER w AS exc, ret
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY pos)) WHERE ret IS NOT NULL AND en IS NOT NULL AND ex IS NOT NULL GROUP BY ALL""")
def leverage_path_study(spark, sf):
    return PF.leverage_study(P.with_returns(spark, sf), leverage=2.0, horizon=5)


@query("AGG-28", "symbol ~ytd ~vol_percentile", digits=5, parts="own", sql="""
SELECT symbol, max(CASE WHEN i = n THEN px END)/max(CASE WHEN i = f THEN px END)-1 AS ytd, avg(CASE WHEN v <= lv THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL) AS vol_percentile FROM (
SELECT *, max(CASE WHEN i = n THEN v END) OVER (PARTITION BY symbol) AS lv, max(CASE WHEN year(session) < y THEN i END) OVER (PARTITION BY symbol) AS f FROM (
SELECT symbol, session, i, px, max(i) OVER (PARTITION BY symbol) AS n, max(year(session)) OVER (PARTITION BY symbol) AS y, round(CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END, 9) AS v FROM (SELECT *, px/lag(px) OVER (PARTITION BY symbol ORDER BY i)-1 AS r FROM own) WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))) GROUP BY symbol""")
def current_year_context(spark, sf):
    return PF.year_context(P.placed(spark, sf))


@query("AGG-09 STAT-23 PRT-25", "symbol condition #n ~mean ~hit ~first_half ~second_half ~worst ~shrunk", digits=5, parts="rets flags", sql="""
WITH c AS (SELECT r.symbol, r.pos, r.ret, x.condition FROM rets r JOIN (SELECT pos, 'WEEKDAY_' || weekday AS condition FROM flags UNION ALL SELECT pos, 'TOM' FROM flags WHERE turn_of_month UNION ALL SELECT pos, 'OPEX' FROM flags WHERE opex_week UNION ALL SELECT pos, 'ALL' FROM flags) x ON x.pos = r.pos WHERE r.ret IS NOT NULL),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol, condition ORDER BY pos) AS i, count(*) OVER (PARTITION BY symbol, condition) AS n FROM c),
 v AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol, condition) AS d FROM k),
 g AS (SELECT a.symbol, a.condition, sum(CASE WHEN l.k = 0 THEN a.d*b.d ELSE 2*(1-l.k/(floor(4*power(a.n/100.0,2.0/9.0))+1))*a.d*b.d END) AS lr FROM v a JOIN (SELECT unnest(generate_series(0,12)) AS k) l ON l.k <= least(a.n-1, floor(4*power(a.n/100.0,2.0/9.0))) JOIN v b ON b.symbol = a.symbol AND b.condition = a.condition AND b.i = a.i - l.k GROUP BY ALL)
SELECT k.symbol, k.condition, count(*) AS n, avg(ret) AS mean, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(ret) FILTER (i*2 <= n) AS first_half, avg(ret) FILTER (i*2 > n) AS second_half, min(ret) AS worst,
 CASE WHEN any_value(lr) > 0 AND abs(avg(ret)/(sqrt(any_value(lr))/count(*))) > 1 THEN avg(ret)*(1-1/power(avg(ret)/(sqrt(any_value(lr))/count(*)),2)) ELSE 0.0 END AS shrunk FROM k JOIN g ON g.symbol = k.symbol AND g.condition = k.condition GROUP BY k.symbol, k.condition HAVING count(*) >= 60""")
def conditional_statistics(spark, sf):
    from ..operators.conditions import calendar_conditions, condition_statistics

    return condition_statistics(P.with_returns(spark, sf), calendar_conditions(P.calendar_table(spark, sf)), 60)
