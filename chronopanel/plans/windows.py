"""Window features (returns, volatility, liquidity, regimes, indicators)."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import recursive as R
from ..operators.frames import framed, over_sessions, shifted
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part


@query("WIN-01 WIN-02 WIN-03", "symbol session ~total_ret ~total_log ~overnight ~overnight_log ~intraday ~intraday_log",
       parts="grid", sql="""
SELECT symbol, session, px/p1-1 AS total_ret, ln(px/p1) AS total_log, open_adj/p1-1 AS overnight,
       ln(open_adj/p1) AS overnight_log, px/open_adj-1 AS intraday, ln(px/open_adj) AS intraday_log
FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY pos) AS p1 FROM grid) WHERE px IS NOT NULL""")
def session_returns(spark, sf):
    return X.session_returns(P.placed(spark, sf))


@query("WIN-04 WIN-05 WIN-06 WIN-08 ASM-02",
       "symbol session ~momentum ~momentum_6_1 ~reversal ~low_volatility ~high_proximity ~from_high ~high_lagged",
       parts="grid", sql="""
SELECT *, high_proximity - 1 AS from_high, lag(high_proximity) OVER (PARTITION BY symbol ORDER BY pos) AS high_lagged FROM (
SELECT symbol, session, pos, px, lag(px,21) OVER w / lag(px,252) OVER w - 1 AS momentum,
       lag(px,21) OVER w / lag(px,126) OVER w - 1 AS momentum_6_1,
       -(px/lag(px,5) OVER w - 1) AS reversal,
       CASE WHEN count(lr) OVER f = 252 THEN -(stddev_samp(lr) OVER f * sqrt(252.0)) END AS low_volatility,
       CASE WHEN count(px) OVER f = 252 THEN px / max(px) OVER f END AS high_proximity
FROM (SELECT *, ln(px/lag(px) OVER (PARTITION BY symbol ORDER BY pos)) AS lr FROM grid)
WINDOW w AS (PARTITION BY symbol ORDER BY pos), f AS (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING))
QUALIFY px IS NOT NULL""")
def canonical_price_features(spark, sf):
    x = X.canonical_features(P.placed(spark, sf)).withColumn("momentum_6_1", X.momentum(126, 21))
    return x.withColumn("from_high", F.col("high_proximity") - 1).withColumn("high_lagged", shifted("high_proximity", 1))


@query("WIN-07 WIN-09 WIN-10 WIN-11 WIN-12 WIN-17",
       "symbol session ~vol21 ~illiquidity ~lottery ~gap21 ~volume_shock ~adv20", parts="rets", sql="""
SELECT symbol, session, CASE WHEN count(ret) OVER f21 = 21 THEN stddev_samp(ret) OVER f21 * sqrt(252.0) END AS vol21,
       CASE WHEN count(dv) OVER f21 = 21 THEN avg(dv) OVER f21 END * 1e9 AS illiquidity,
       CASE WHEN count(ret) OVER f21 = 21 THEN max(ret) OVER f21 END AS lottery,
       CASE WHEN count(gap) OVER f21 = 21 THEN avg(gap) OVER f21 END AS gap21,
       CASE WHEN count(volume) OVER v5 = 5 THEN avg(volume) OVER v5 END
         / CASE WHEN count(volume) OVER v60 = 60 THEN avg(volume) OVER v60 END AS volume_shock,
       coalesce(avg(px*volume) OVER a20, 1e8) AS adv20
FROM (SELECT *, abs(ret)/nullif(px*volume,0) AS dv, (open_adj/px1-1)-(px/open_adj-1) AS gap FROM rets)
WINDOW f21 AS (PARTITION BY symbol ORDER BY pos ROWS 20 PRECEDING),
       v5 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
       v60 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
       a20 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
QUALIFY px IS NOT NULL""")
def liquidity_features(spark, sf):
    return P.with_returns(spark, sf).select(
        "symbol", "session", X.simple_volatility().alias("vol21"), (X.amihud() * 1e9).alias("illiquidity"),
        X.max_lottery().alias("lottery"), X.overnight_gap().alias("gap21"), X.volume_shock().alias("volume_shock"),
        X.trailing_dollar_volume().alias("adv20"))


part("mkt", "rets", "SELECT session, pos, avg(ret) AS mkt FROM rets GROUP BY session, pos")
part("peers", "rets", """
SELECT *, CASE WHEN ret IS NOT NULL AND count(ret) OVER w > 1
               THEN (sum(ret) OVER w - ret) / (count(ret) OVER w - 1) END AS peer
FROM rets WINDOW w AS (PARTITION BY session, sector)""")
part("betas", "peers mkt", """
SELECT *, (cam*vs - cas*cms)/CASE WHEN abs(det) > 2.220446049250313e-16 THEN det END AS beta_market,
       (cas*vm - cam*cms)/CASE WHEN abs(det) > 2.220446049250313e-16 THEN det END AS beta_sector
FROM (SELECT *, vm*vs - cms*cms AS det FROM (
SELECT p.symbol, p.sector, p.session, p.pos, p.px, p.ret, p.peer, m.mkt,
  CASE WHEN count(m.mkt) OVER f >= 126 THEN avg(m.mkt*m.mkt) OVER f - power(avg(m.mkt) OVER f, 2) END AS vm,
  CASE WHEN count(peer) OVER f >= 126 THEN avg(peer*peer) OVER f - power(avg(peer) OVER f, 2) END AS vs,
  CASE WHEN count(m.mkt*peer) OVER f >= 126 THEN avg(m.mkt*peer) OVER f
    - avg(CASE WHEN peer IS NOT NULL THEN m.mkt END) OVER f * avg(CASE WHEN m.mkt IS NOT NULL THEN peer END) OVER f END AS cms,
  CASE WHEN count(m.mkt*ret) OVER f >= 126 THEN avg(m.mkt*ret) OVER f
    - avg(CASE WHEN ret IS NOT NULL THEN m.mkt END) OVER f * avg(CASE WHEN m.mkt IS NOT NULL THEN ret END) OVER f END AS cam,
  CASE WHEN count(peer*ret) OVER f >= 126 THEN avg(peer*ret) OVER f
    - avg(CASE WHEN ret IS NOT NULL THEN peer END) OVER f * avg(CASE WHEN peer IS NOT NULL THEN ret END) OVER f END AS cas
FROM peers p JOIN mkt m ON p.pos = m.pos
WINDOW f AS (PARTITION BY p.symbol ORDER BY p.pos ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)))""")
part("reversals", "betas", """
SELECT *, -own_n AS raw, -(own_n - peer_n) AS sector_neutral,
       -(own_n - beta_market*mkt_n - beta_sector*peer_n)
         / CASE WHEN abs(resid_vol*sqrt(5.0)) > 1e-12 THEN resid_vol*sqrt(5.0) END AS residual
FROM (SELECT *, px/lag(px,5) OVER w - 1 AS own_n,
  CASE WHEN count(peer) OVER f5 = 5 THEN exp(sum(ln(1+peer)) OVER f5) - 1 END AS peer_n,
  CASE WHEN count(mkt) OVER f5 = 5 THEN exp(sum(ln(1+mkt)) OVER f5) - 1 END AS mkt_n,
  CASE WHEN count(resid) OVER f20 = 20 THEN stddev_samp(resid) OVER f20 END AS resid_vol
FROM (SELECT *, ret - beta_market*mkt - beta_sector*peer AS resid FROM betas)
WINDOW w AS (PARTITION BY symbol ORDER BY pos), f5 AS (PARTITION BY symbol ORDER BY pos ROWS 4 PRECEDING),
       f20 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE px IS NOT NULL""")


@query("WIN-13", "symbol session ~sd252 ~sd63 ~beta252", parts="rets mkt", sql="""
SELECT symbol, session, CASE WHEN count(ret) OVER f = 252 THEN stddev_samp(ret) OVER f END AS sd252,
       CASE WHEN count(ret) OVER g = 63 THEN stddev_samp(ret) OVER g END AS sd63,
       CASE WHEN count(ret*mkt) OVER f = 252 THEN covar_samp(ret,mkt) OVER f END
         / CASE WHEN count(mkt) OVER f = 252 THEN nullif(var_samp(mkt) OVER f,0) END AS beta252
FROM (SELECT r.*, m.mkt FROM rets r JOIN mkt m ON r.pos = m.pos)
WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING),
       g AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)
QUALIFY px IS NOT NULL""")
def risk_ranking_features(spark, sf):
    return X.risk_ranking_features(P.with_returns(spark, sf))


@query("WIN-14", "symbol session ~beta_market ~beta_sector", digits=5, parts="betas",
       sql="SELECT symbol, session, beta_market, beta_sector FROM betas WHERE px IS NOT NULL")
def rolling_two_factor_betas(spark, sf):
    return X.two_factor_betas(P.with_returns(spark, sf))


@query("WIN-15 WIN-16", "symbol session ~raw ~sector_neutral ~residual ~peer_n ~mkt_n ~resid_vol", digits=5,
       parts="reversals", sql="SELECT symbol, session, raw, sector_neutral, residual, peer_n, mkt_n, resid_vol FROM reversals")
def reversal_signal_set(spark, sf):
    return P.kept(spark, sf, "reversals", lambda: X.reversal_signals(P.with_returns(spark, sf)))


@query("WIN-18 WIN-25 WIN-29", "symbol session ~sma20 regime regime_lagged vol_state break20 break63 break252", parts="grid",
       sql="""
SELECT *, coalesce(lag(regime) OVER (PARTITION BY symbol ORDER BY pos), 'UNKNOWN') AS regime_lagged FROM (
SELECT symbol, session, pos, px, CASE WHEN count(px) OVER f20 = 20 THEN avg(px) OVER f20 END AS sma20,
  CASE WHEN count(px) OVER f200 < 200 OR px IS NULL THEN 'UNKNOWN' WHEN px > avg(px) OVER f200 THEN 'UP' ELSE 'DOWN' END AS regime,
  CASE WHEN count(px) OVER f20 < 20 THEN 'UNKNOWN' WHEN stddev_samp(px) OVER f20 < 4 THEN 'LOW'
       WHEN stddev_samp(px) OVER f20 <= 7 THEN 'NORMAL' ELSE 'HIGH' END AS vol_state,
  coalesce(count(px) OVER f20 = 20 AND px = max(px) OVER f20, false) AS break20,
  coalesce(count(px) OVER f63 = 63 AND px = max(px) OVER f63, false) AS break63,
  coalesce(count(px) OVER f252 = 252 AND px = max(px) OVER f252, false) AS break252
FROM grid WINDOW f20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING),
  f63 AS (PARTITION BY symbol ORDER BY pos ROWS 62 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY pos ROWS 199 PRECEDING),
  f252 AS (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING)) QUALIFY px IS NOT NULL""")
def moving_average_regimes(spark, sf):
    level = framed(F.stddev_samp("px"), "px", 20)

    def breakout(n):
        return F.coalesce(F.col("px") == framed(F.max("px"), "px", n), F.lit(False)).alias(f"break{n}")

    x = P.placed(spark, sf).select(
        "symbol", "session", "pos", framed(F.avg("px"), "px", 20).alias("sma20"), X.ma_regime().alias("regime"),
        X.vol_index_regime(level, 4.0, 7.0).alias("vol_state"), breakout(20), breakout(63), breakout(252))
    return x.withColumn("regime_lagged", F.coalesce(shifted("regime", 1), F.lit("UNKNOWN")))


@query("WIN-19", "trial session ~equity ~peak ~drawdown", parts="rets", sql="""
SELECT trial, session, equity, greatest(1.0, max(equity) OVER w) AS peak, equity/greatest(1.0, max(equity) OVER w)-1 AS drawdown
FROM (SELECT symbol AS trial, session, pos, exp(sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY symbol ORDER BY pos)) AS equity
      FROM rets WHERE px IS NOT NULL) WINDOW w AS (PARTITION BY trial ORDER BY pos)""")
def equity_and_drawdown(spark, sf):
    return X.drawdown(P.with_returns(spark, sf).withColumnRenamed("symbol", "trial"))


part("own", "grid", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM grid WHERE px IS NOT NULL")
part("trs", "own", """
SELECT symbol, session, i, px, greatest(high_adj-low_adj, coalesce(abs(high_adj-p1), high_adj-low_adj),
       coalesce(abs(low_adj-p1), high_adj-low_adj)) AS tr, greatest(px-p1,0) AS up, greatest(p1-px,0) AS down
FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY i) AS p1 FROM own)""")
part("ewm", "trs", """
SELECT symbol, session, i, px AS ema, tr AS atr, CAST(NULL AS DOUBLE) AS u14, CAST(NULL AS DOUBLE) AS d14,
       CAST(NULL AS DOUBLE) AS u2, CAST(NULL AS DOUBLE) AS d2, tr FROM trs WHERE i = 1
UNION ALL
SELECT t.symbol, t.session, t.i, e.ema*(1-2.0/21)+t.px*(2.0/21), e.atr*(1-1.0/14)+t.tr*(1.0/14),
       coalesce(e.u14*(1-1.0/14)+t.up*(1.0/14), t.up), coalesce(e.d14*(1-1.0/14)+t.down*(1.0/14), t.down),
       coalesce(e.u2*0.5+t.up*0.5, t.up), coalesce(e.d2*0.5+t.down*0.5, t.down), t.tr
FROM ewm e JOIN trs t ON t.symbol = e.symbol AND t.i = e.i + 1""")


@query("WIN-20 WIN-21 WIN-22", "symbol session ~ema20 ~rsi14 ~rsi2 ~tr ~atr14 ~atr14_early", digits=5, parts="ewm", sql="""
SELECT symbol, session, CASE WHEN i >= 20 THEN ema END AS ema20,
  CASE WHEN i >= 15 THEN CASE WHEN d14 = 0 AND u14 > 0 THEN 100.0 WHEN d14 = 0 THEN 50.0 ELSE 100.0-100.0/(1.0+u14/d14) END END AS rsi14,
  CASE WHEN i >= 3 THEN CASE WHEN d2 = 0 AND u2 > 0 THEN 100.0 WHEN d2 = 0 THEN 50.0 ELSE 100.0-100.0/(1.0+u2/d2) END END AS rsi2,
  tr, CASE WHEN i >= 14 THEN atr END AS atr14, atr AS atr14_early FROM ewm""")
def recursive_indicators(spark, sf):
    return P.kept(spark, sf, "indicators", lambda: R.indicators(P.placed(spark, sf)))


@query("WIN-22", "symbol session ~atr_percent", parts="trs", sql="""
SELECT symbol, session, CASE WHEN count(tr) OVER f = 14 THEN avg(tr) OVER f END / px AS atr_percent FROM trs
WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)""")
def plain_atr_percent(spark, sf):
    own = W.partitionBy("symbol").orderBy("session")
    x = P.placed(spark, sf).withColumn("prior_close", F.lag("px").over(own)).withColumn("tr", X.true_range("high_adj", "low_adj"))
    f = own.rowsBetween(-13, 0)
    return x.select("symbol", "session", (F.when(F.count("tr").over(f) == 14, F.avg("tr").over(f)) / F.col("px")).alias("atr_percent"))


@query("WIN-23", "symbol session ~pct_b", parts="own", sql="""
SELECT symbol, session, CASE WHEN count(px) OVER f = 20 AND stddev_pop(px) OVER f > 2.5e-10
  THEN (px - (avg(px) OVER f - 2*stddev_pop(px) OVER f)) / (4*stddev_pop(px) OVER f) END AS pct_b
FROM own WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING)""")
def bollinger_percent_b(spark, sf):
    return P.placed(spark, sf).select("symbol", "session", X.bollinger_b().alias("pct_b"))


@query("WIN-24", "#event_id ~money #shares ~premium", sql="""
SELECT event_id, money, shares, value/nullif(money/nullif(shares,0),0)-1 AS premium FROM (
SELECT event_id, value, sum(value*k) OVER w AS money, sum(k) OVER w AS shares
FROM (SELECT event_id, ts, event_type, value, CAST(json_extract(props,'$.k') AS DOUBLE) AS k FROM events)
WINDOW w AS (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""")
def session_vwap(spark, sf):
    from ..sources.ticks import ticks

    from ..operators.running import running

    t = ticks(spark, sf).withColumn("traded", F.col("price") * F.col("size")).withColumn("minute", F.date_trunc("minute", "ts"))
    x = running(t, ["symbol", "session"], "minute", ["ts", "event_id"], {"money": "traded", "shares": "size"})
    vwap = F.col("money") / F.nullif("shares", F.lit(0.0))
    return x.withColumn("premium", F.col("price") / F.nullif(vwap, F.lit(0.0)) - 1)


@query("WIN-26 WIN-53", "symbol session ~percentile ~exposure ~flip_cost", parts="mkt", sql="""
SELECT 'MKT' AS symbol, session, pctl AS percentile, coalesce(lag(CAST(pctl > 0.8 AS DOUBLE)) OVER (ORDER BY pos), 0) AS exposure,
  5e-4*abs(coalesce(lag(CAST(pctl > 0.8 AS DOUBLE)) OVER (ORDER BY pos), 0) - coalesce(lag(CAST(pctl > 0.8 AS DOUBLE), 2) OVER (ORDER BY pos), 0)) AS flip_cost
FROM (SELECT a.session, a.pos, CASE WHEN count(b.x) >= 252 THEN
   (count(CASE WHEN b.x < a.x THEN 1 END) + count(CASE WHEN b.x <= a.x THEN 1 END)) / 2.0 / (count(b.x) + 1) END AS pctl
 FROM (SELECT session, pos, round(mkt, 6) AS x FROM mkt WHERE mkt IS NOT NULL) a
 LEFT JOIN (SELECT pos, round(mkt, 6) AS x FROM mkt WHERE mkt IS NOT NULL) b ON b.pos < a.pos GROUP BY a.session, a.pos, a.x)""")
def volatility_index_rule(spark, sf):
    from ..operators.expanding import expanding_percentile

    m = X.market_return(P.with_returns(spark, sf)).where("mkt is not null")
    x = expanding_percentile(m.select(F.lit("MKT").alias("symbol"), "session", "pos", F.round("mkt", 6).alias("x")), "x", 252)
    w = W.partitionBy("symbol").orderBy("pos")
    on = F.coalesce(F.col("percentile") > 0.8, F.lit(None).cast("boolean")).cast("double")
    x = x.withColumn("on", on)
    x = x.withColumn("exposure", F.coalesce(F.lag("on").over(w), F.lit(0.0)))
    return x.withColumn("flip_cost", F.lit(5e-4) * F.abs(F.col("exposure") - F.coalesce(F.lag("on", 2).over(w), F.lit(0.0))))


@query("WIN-27", "symbol session ~q67 ~q90", parts="rets", sql="""
SELECT symbol, session, CASE WHEN count(x) OVER f >= 252 THEN quantile_cont(x, 2.0/3.0) OVER f END AS q67,
  CASE WHEN count(x) OVER f >= 252 THEN quantile_cont(x, 0.9) OVER f END AS q90
FROM (SELECT *, abs(ret) AS x FROM rets) WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
QUALIFY px IS NOT NULL""")
def expanding_quantile_thresholds(spark, sf):
    from ..operators.expanding import expanding_quantiles

    x = P.with_returns(spark, sf).select("symbol", "session", "pos", F.abs("ret").alias("x"))
    return expanding_quantiles(x, "x", {"q67": 2.0 / 3.0, "q90": 0.9}, 252)


@query("WIN-28", "symbol session ~vol_lag tercile", parts="rets", sql="""
SELECT v.symbol, v.session, vol_lag, CASE WHEN vol_lag IS NULL OR q1 IS NULL THEN 'UNKNOWN' WHEN vol_lag <= q1 THEN 'LOW'
  WHEN vol_lag <= q2 THEN 'MID' ELSE 'HIGH' END AS tercile
FROM v LEFT JOIN (SELECT symbol, quantile_cont(vol_lag, 1.0/3.0) AS q1, quantile_cont(vol_lag, 2.0/3.0) AS q2
  FROM v WHERE session < DATE '1999-01-01' GROUP BY symbol) q USING (symbol) WHERE px IS NOT NULL""".replace(
    "FROM v LEFT", "FROM (SELECT symbol, session, px, CASE WHEN count(ret) OVER f = 21 THEN stddev_samp(ret) OVER f END AS vol_lag FROM rets WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)) v LEFT").replace(
    "FROM v WHERE", "FROM (SELECT symbol, session, CASE WHEN count(ret) OVER f = 21 THEN stddev_samp(ret) OVER f END AS vol_lag, px FROM rets WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)) v WHERE px IS NOT NULL AND"))
def realized_volatility_terciles(spark, sf):
    v = P.with_returns(spark, sf).select("symbol", "session", framed(F.stddev_samp("ret"), "ret", 21, end=-1).alias("vol_lag"))
    cuts = v.where(F.col("session") < F.lit("1999-01-01").cast("date")).groupBy("symbol").agg(
        F.percentile("vol_lag", F.lit(1.0 / 3.0)).alias("q1"), F.percentile("vol_lag", F.lit(2.0 / 3.0)).alias("q2"))
    x = F.col("vol_lag")
    return v.join(cuts, "symbol", "left").withColumn(
        "tercile", F.when(x.isNull() | F.col("q1").isNull(), "UNKNOWN").when(x <= F.col("q1"), "LOW")
        .when(x <= F.col("q2"), "MID").otherwise("HIGH"))


part("spreads", "grid", """
SELECT *, CASE WHEN cs > 1e-12 THEN cs END AS cs_spread, CASE WHEN ar2 > 1e-12 THEN sqrt(ar2) END AS ar_spread FROM (
SELECT *, 2*(exp(alpha)-1)/(1+exp(alpha)) AS cs FROM (
SELECT *, (sqrt(2*beta)-sqrt(beta))/(3-2*sqrt(2.0)) - sqrt(gamma/(3-2*sqrt(2.0))) AS alpha FROM (
SELECT symbol, session, pos, px, asset_type,
  power(ln(high_adj/low_adj),2) + power(ln(lag(high_adj) OVER w/lag(low_adj) OVER w),2) AS beta,
  power(ln(greatest(high_adj, lag(high_adj) OVER w)/least(low_adj, lag(low_adj) OVER w)),2) AS gamma,
  4*(ln(px)-(ln(high_adj)+ln(low_adj))/2)*(ln(px)-(ln(lead(high_adj) OVER w)+ln(lead(low_adj) OVER w))/2) AS ar2
FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY pos)))) WHERE px IS NOT NULL""")
part("month_spreads", "spreads", """
SELECT symbol, CAST(date_trunc('month', session) AS DATE) AS month, count(x) AS n_days,
  CASE WHEN count(x) >= 12 THEN quantile_cont(x, 0.5)*10000 END AS spread_bps
FROM (SELECT *, coalesce(cs_spread, ar_spread) AS x FROM spreads) GROUP BY ALL""")


@query("WIN-33 WIN-34", "symbol session ~cs_spread ~ar_spread", parts="spreads",
       sql="SELECT symbol, session, cs_spread, ar_spread FROM spreads")
def range_spread_estimates(spark, sf):
    return P.placed(spark, sf).select("*", X.corwin_schultz().alias("cs_spread"), X.abdi_ranaldo().alias("ar_spread"))


@query("AGG-10", "symbol month #n_days ~spread_bps", parts="month_spreads", sql="SELECT * FROM month_spreads")
def monthly_median_spread(spark, sf):
    x = range_spread_estimates(spark, sf).withColumn("x", F.coalesce("cs_spread", "ar_spread"))
    return x.groupBy("symbol", F.trunc("session", "MM").alias("month")).agg(
        F.count("x").alias("n_days"), F.when(F.count("x") >= 12, F.percentile("x", F.lit(0.5)) * 10000).alias("spread_bps"))


@query("WIN-35", "symbol session ~spread_bps", parts="month_spreads bars", sql="""
SELECT b.symbol, b.session, greatest(coalesce(m.spread_bps, 0), CASE WHEN asset_type = 'etf' THEN 1.0 ELSE 3.0 END) AS spread_bps
FROM bars b LEFT JOIN month_spreads m ON m.symbol = b.symbol
 AND m.month = CAST(date_trunc('month', b.session) - INTERVAL 1 MONTH AS DATE)""")
def floored_session_spread(spark, sf):
    months = monthly_median_spread(spark, sf).select("symbol", F.add_months("month", 1).alias("m"), "spread_bps")
    floor = F.when(F.col("asset_type") == "etf", 1.0).otherwise(3.0)
    return P.bars(spark, sf).withColumn("m", F.trunc("session", "MM")).join(months, ["symbol", "m"], "left").select(
        "symbol", "session", F.greatest(F.coalesce("spread_bps", F.lit(0.0)), floor).alias("spread_bps"))


@query("WIN-41", "symbol session ~w1 ~w2", parts="rets", sql="""
SELECT symbol, session, coalesce(lag(s,1) OVER w,0) AS w1, coalesce(lag(s,2) OVER w,0) AS w2
FROM (SELECT *, coalesce(sign(ret),0) AS s FROM rets) WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
def lagged_positions(spark, sf):
    w = W.partitionBy("symbol").orderBy("pos")
    s = F.coalesce(F.signum("ret"), F.lit(0.0))
    x = P.grid(spark, sf).withColumn("s", s)
    return x.select("symbol", "session", F.coalesce(F.lag("s", 1).over(w), F.lit(0.0)).alias("w1"),
                    F.coalesce(F.lag("s", 2).over(w), F.lit(0.0)).alias("w2"))


@query("WIN-42", "symbol session ~target", parts="rets", sql="""
SELECT symbol, session, avg(CASE WHEN ret < -0.1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol ORDER BY pos ROWS 4 PRECEDING) AS target FROM rets""")
def overlapping_cohorts(spark, sf):
    from ..operators.portfolio import overlapping_cohorts as cohorts

    x = P.grid(spark, sf).withColumn("entry", F.when(F.col("ret") < -0.1, 1.0).otherwise(0.0))
    return cohorts(x, "entry", 5, "target")


@query("WIN-45", "symbol session ~carried63 ~carried21", parts="rets", sql="""
SELECT symbol, session, last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS 62 PRECEDING) AS carried63,
  last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS 20 PRECEDING) AS carried21
FROM (SELECT *, CASE WHEN abs(ret) > 0.15 THEN ret END AS s FROM rets)""")
def limited_forward_fill(spark, sf):
    s = F.when(F.abs("ret") > 0.15, F.col("ret"))
    x = P.grid(spark, sf).withColumn("s", s)
    w = W.partitionBy("symbol").orderBy("pos")
    return x.select("symbol", "session", F.last("s", True).over(w.rowsBetween(-62, 0)).alias("carried63"),
                    F.last("s", True).over(w.rowsBetween(-20, 0)).alias("carried21"))


@query("WIN-43 WIN-44", "symbol session ~monthly_hold ~position ~flip", parts="rets", sql="""
SELECT symbol, session, monthly_hold, position, CAST(position <> lag(position) OVER (PARTITION BY symbol ORDER BY pos) AS DOUBLE) AS flip FROM (
SELECT symbol, session, pos, coalesce(last_value(first_w IGNORE NULLS) OVER h, 0) AS monthly_hold,
  coalesce(last_value(end_w IGNORE NULLS) OVER p, 0) AS position FROM (
SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY pos) = 1 THEN coalesce(sign(ret),0) END AS first_w,
  CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', session) ORDER BY pos DESC) = 1 THEN coalesce(sign(ret),0) END AS end_w FROM rets)
WINDOW h AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def month_boundary_positions(spark, sf):
    from ..operators.portfolio import month_end_decisions, month_start_hold

    x = P.grid(spark, sf).withColumn("s", F.coalesce(F.signum("ret"), F.lit(0.0)))
    x = month_end_decisions(month_start_hold(x, "s", "monthly_hold"), "s", "position")
    w = W.partitionBy("symbol").orderBy("pos")
    return x.withColumn("flip", (F.col("position") != F.lag("position").over(w)).cast("double"))


@query("WIN-47", "session ~target", parts="cal", sql="""
SELECT session, lead(t) OVER (ORDER BY pos) AS target FROM (
SELECT session, pos, least(1.0, sum(CASE WHEN isodow(session) = 1 THEN 1.0 ELSE 0.0 END) OVER (ORDER BY pos ROWS 2 PRECEDING)) AS t FROM cal)""")
def spread_calendar_target(spark, sf):
    one = W.partitionBy(F.lit(1)).orderBy("pos")
    flag = F.when(F.weekday("session") == 0, 1.0).otherwise(0.0)
    t = P.calendar(spark, sf).withColumn("t", F.least(F.lit(1.0), F.sum(flag).over(one.rowsBetween(-2, 0))))
    return t.select("session", F.lead("t").over(one).alias("target"))


@query("WIN-49", "symbol session ~forward ~market_leg ~sector_leg ~label label_end", digits=5, parts="betas", sql="""
SELECT symbol, session, forward, market_leg, sector_leg, label_end,
  forward - beta_market*market_leg - beta_sector*sector_leg - 8/10000.0 - 0.003*5/365 AS label
FROM (SELECT *, lead(px,6) OVER w/lead(px,1) OVER w - 1 AS forward, lead(session,6) OVER w AS label_end,
 CASE WHEN count(mkt) OVER f = 5 THEN exp(sum(ln(1+mkt)) OVER f)-1 END AS market_leg,
 CASE WHEN count(peer) OVER f = 5 THEN exp(sum(ln(1+peer)) OVER f)-1 END AS sector_leg FROM betas
WINDOW w AS (PARTITION BY symbol ORDER BY pos), f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)) WHERE px IS NOT NULL""")
def forward_labels(spark, sf):
    from ..operators.labels import forward_label

    return P.kept(spark, sf, "labels", lambda: forward_label(
        P.kept(spark, sf, "reversals", lambda: X.reversal_signals(P.with_returns(spark, sf))), P.calendar(spark, sf)))


@query("WIN-50", "symbol session ~r1 ~r2 ~r3 ~r5 ~r10 ~r20 ~abnormal_volume ~gap_fraction ~vol_expansion ~log_adv ~range_pos", parts="rets", sql="""
SELECT symbol, session, ret AS r1, px/lag(px,2) OVER w-1 AS r2, px/lag(px,3) OVER w-1 AS r3, px/lag(px,5) OVER w-1 AS r5,
  px/lag(px,10) OVER w-1 AS r10, px/lag(px,20) OVER w-1 AS r20,
  volume/CASE WHEN count(volume) OVER b20 = 20 THEN avg(volume) OVER b20 END - 1 AS abnormal_volume,
  abs(open_adj/px1-1)/(abs(open_adj/px1-1)+abs(px/open_adj-1)+1e-12) AS gap_fraction,
  CASE WHEN count(ret) OVER f5 = 5 THEN stddev_samp(ret) OVER f5 END / CASE WHEN count(ret) OVER f20 = 20 THEN stddev_samp(ret) OVER f20 END AS vol_expansion,
  ln(1+avg(px*volume) OVER b20) AS log_adv, (px-low_adj)/nullif(high_adj-low_adj,0) AS range_pos
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY pos), f5 AS (PARTITION BY symbol ORDER BY pos ROWS 4 PRECEDING),
 f20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING), b20 AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
QUALIFY px IS NOT NULL""")
def model_features(spark, sf):
    from ..operators.labels import model_features as build

    return build(P.with_returns(spark, sf))


@query("WIN-51", "symbol session ~ma200 ~vol20 ~ibs three_down calm dip", parts="own", sql="""
SELECT symbol, session, ma200, vol20, ibs, three_down, coalesce(vol20 < 1.4 AND ibs > 0.2, false) AS calm,
 coalesce(px < ma200 AND ibs < 0.2, false) AS dip FROM (
SELECT symbol, session, i, px, CASE WHEN count(px) OVER f200 = 200 THEN avg(px) OVER f200 END AS ma200,
 CASE WHEN count(r) OVER f20 = 20 THEN stddev_samp(r) OVER f20 * sqrt(252.0) END AS vol20,
 (px-low_adj)/nullif(high_adj-low_adj,0) AS ibs, coalesce(r < 0 AND lag(r) OVER w < 0 AND lag(r,2) OVER w < 0, false) AS three_down
FROM (SELECT *, px/lag(px) OVER (PARTITION BY symbol ORDER BY i)-1 AS r FROM own)
WINDOW w AS (PARTITION BY symbol ORDER BY i), f20 AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING), f200 AS (PARTITION BY symbol ORDER BY i ROWS 199 PRECEDING))
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1""")
def current_state_row(spark, sf):
    from ..operators.advisor import current_state

    return current_state(P.placed(spark, sf))


@query("WIN-52", "symbol session #horizon ~ret", parts="rets", sql="""
SELECT symbol, lead(session, h) OVER w AS session, h AS horizon, lead(px,h) OVER w / lead(open_adj,1) OVER w - 1 AS ret, flag
FROM (SELECT *, coalesce(ret < -0.2, false) AS flag FROM rets) CROSS JOIN (VALUES (1),(3),(5)) t(h)
WINDOW w AS (PARTITION BY symbol, h ORDER BY pos)
QUALIFY flag AND lead(px,h) OVER w / lead(open_adj,1) OVER w IS NOT NULL""")
def event_horizon_returns(spark, sf):
    from ..operators.labels import event_returns

    x = P.with_returns(spark, sf).withColumn("flag", F.col("ret") < -0.2)
    return event_returns(x, "flag", (1, 3, 5), P.calendar(spark, sf))


part("stop_gaps", "ewm own", """
SELECT symbol, atr AS atr14, px-2*atr AS stop_long, gap_p99, (open_adj-p1)/atr AS gap_atr FROM (
SELECT e.symbol, e.atr, o.px, o.open_adj, lag(o.px) OVER (PARTITION BY e.symbol ORDER BY e.i) AS p1, e.i, max(e.i) OVER (PARTITION BY e.symbol) AS n
FROM ewm e JOIN own o ON o.symbol = e.symbol AND o.i = e.i) JOIN (
SELECT symbol, quantile_cont(greatest(1-open_adj/p1,0), 0.99) AS gap_p99 FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY i) AS p1 FROM own) WHERE p1 IS NOT NULL GROUP BY symbol)
USING (symbol) WHERE i = n""")


@query("WIN-54", "symbol ~atr14 ~stop_long ~gap_p99 ~gap_atr", digits=5, parts="stop_gaps", sql="SELECT * FROM stop_gaps")
def stop_and_gap_risk(spark, sf):
    from ..operators.advisor import stop_and_gap

    return stop_and_gap(P.placed(spark, sf), recursive_indicators(spark, sf))
