"""Trial streams and their statistics."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import inference as I
from ..operators import streams as S
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part

# Selected entries -> dense positions by a five-row mean, shifted two rows: the matrix formulation.
part("entries", "reversals", """
SELECT signal || '|' || k || '|' || side AS trial, symbol, pos, CASE side WHEN 'LONG' THEN 1.0 ELSE -1.0 END / k AS weight FROM (
SELECT *, row_number() OVER (PARTITION BY signal, session ORDER BY score DESC, symbol) AS a, row_number() OVER (PARTITION BY signal, session ORDER BY score, symbol) AS b,
 count(*) OVER (PARTITION BY signal, session) AS n FROM (
 SELECT symbol, session, pos, 'raw' AS signal, raw AS score FROM reversals UNION ALL SELECT symbol, session, pos, 'sector_neutral', sector_neutral FROM reversals
 UNION ALL SELECT symbol, session, pos, 'residual', residual FROM reversals) WHERE score IS NOT NULL)
 CROSS JOIN (VALUES (1),(2),(3),(5),(8)) t(k) CROSS JOIN (VALUES ('LONG'),('SHORT')) s(side)
WHERE n >= k AND CASE side WHEN 'LONG' THEN a ELSE b END <= k""")
part("cube", "entries rets", """
SELECT trial, symbol, pos, session, ret, asset_type, adv, weight, coalesce(lag(weight) OVER (PARTITION BY trial, symbol ORDER BY pos), 0) AS previous FROM (
SELECT t.trial, g.symbol, g.pos, g.session, g.ret, g.asset_type, g.adv,
  coalesce(sum(e.weight) OVER (PARTITION BY t.trial, g.symbol ORDER BY g.pos ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING), 0)/5 AS weight
FROM (SELECT DISTINCT trial FROM entries) t CROSS JOIN (SELECT *, CASE WHEN px IS NULL THEN 1e8 ELSE coalesce(avg(px*volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),1e8) END AS adv FROM rets) g
LEFT JOIN entries e ON e.trial = t.trial AND e.symbol = g.symbol AND e.pos = g.pos)""")
part("streams", "cube", """
SELECT trial, pos, session, gross, cost, turnover, exposure, gross - cost AS net FROM (
SELECT trial, pos, session, sum(coalesce(weight*ret,0)) AS gross, sum(abs(weight-previous))/2 AS turnover, sum(abs(weight)) AS exposure,
 sum((abs(weight-previous)*(CASE WHEN asset_type='etf' THEN 1.0 ELSE 3.0 END/2 + least(1.0+10.0*sqrt(abs(weight-previous)*100000.0/adv),50.0) + 1.0)
  + greatest(-weight,0)*0.003/365.0*10000.0)/10000.0) AS cost FROM cube GROUP BY trial, pos, session)""")


# Bartlett t of any labelled series: (grp, i-ordered v) -> n, mean, t.
def hac_sql(rows: str, keys: str, holding: int = 1) -> str:
    on = " AND ".join(f"b.{k} = a.{k}" for k in keys.split(", "))
    on_m = " AND ".join(f"m.{k} = a.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""c AS (SELECT {keys}, v - avg(v) OVER (PARTITION BY {keys}) AS c, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i FROM ({rows})),
 m AS (SELECT {keys}, count(*) AS n, avg(v) AS mean, CAST(least(count(*)-1, greatest(floor(4*power(count(*)/100.0,2.0/9.0)),{holding - 1})) AS BIGINT) AS lags FROM ({rows}) GROUP BY {keys}),
 g AS (SELECT {a_keys}, l.k, sum(a.c*b.c) AS g FROM c a JOIN m ON {on_m} JOIN (SELECT unnest(generate_series(0,12)) AS k) l ON l.k <= m.lags JOIN c b ON {on} AND b.i = a.i - l.k GROUP BY {a_keys}, l.k),
 hac AS (SELECT {keys}, n, mean, CASE WHEN sum(CASE WHEN k = 0 THEN g ELSE 2*(1-k/(lags+1.0))*g END) <= 0 THEN 0.0 ELSE mean/sqrt(greatest(sum(CASE WHEN k = 0 THEN g ELSE 2*(1-k/(lags+1.0))*g END),0)/n/n) END AS t FROM m JOIN g USING ({keys}) GROUP BY {keys}, n, mean, lags)"""


def market(spark, sf):
    return P.kept(spark, sf, "market", lambda: P.with_returns(spark, sf).withColumn("adv20", FE.trailing_dollar_volume()))


def signals(spark, sf):
    return P.kept(spark, sf, "reversals", lambda: FE.reversal_signals(P.with_returns(spark, sf)))


def streams(spark, sf):
    def build():
        pos = S.positions(S.reversal_entries(signals(spark, sf)), 5, 2)
        return S.evaluate(pos, market(spark, sf), P.calendar(spark, sf))

    return P.kept(spark, sf, "streams", build)


@query("PRT-01 PRT-02 PRT-03 AGG-01 PRT-08", "trial session ~gross ~cost ~turnover ~exposure ~net", digits=5, parts="streams", sql="SELECT * FROM streams")
def trial_streams(spark, sf):
    return streams(spark, sf)


# Bartlett sums by a self join on row offsets.
part("hacs", "streams", """
WITH c AS (SELECT trial, net, row_number() OVER (PARTITION BY trial ORDER BY pos) AS i, count(*) OVER (PARTITION BY trial) AS n, net - avg(net) OVER (PARTITION BY trial) AS c FROM streams),
 m AS (SELECT trial, any_value(n) AS n, avg(net) AS mean, sum(c*c)/any_value(n) AS g0, CAST(least(any_value(n)-1, greatest(floor(4*power(any_value(n)/100.0, 2.0/9.0)), 4)) AS BIGINT) AS lags FROM c GROUP BY trial),
 g AS (SELECT a.trial, l.k, sum(a.c*b.c)/any_value(a.n) AS gk FROM c a JOIN m ON m.trial = a.trial JOIN (SELECT unnest(generate_series(1,12)) AS k) l ON l.k <= m.lags JOIN c b ON b.trial = a.trial AND b.i = a.i - l.k GROUP BY a.trial, l.k)
SELECT m.trial, m.n, m.mean, m.lags, sqrt(greatest(m.g0 + sum(2*(1-g.k/(m.lags+1.0))*g.gk), 0)/m.n) AS se,
 m.mean/sqrt(greatest(m.g0 + sum(2*(1-g.k/(m.lags+1.0))*g.gk), 0)/m.n) AS t FROM m JOIN g ON g.trial = m.trial GROUP BY m.trial, m.n, m.mean, m.lags, m.g0""")


@query("STAT-01", "trial #n ~mean ~se ~t #lags", parts="hacs", sql="SELECT * FROM hacs")
def hac_mean_tests(spark, sf):
    return tests(spark, sf)


def tests(spark, sf):
    return P.kept(spark, sf, "hacs", lambda: I.hac(streams(spark, sf), ["trial"], "pos", "net", holding=5))


part("summ", "streams", """
SELECT trial, n, mean, sd, CASE WHEN sd > 0 THEN mean/sd*sqrt(252.0) END AS sharpe, hit_rate,
 m3/power(m2,1.5)*sqrt(n*(n-1.0))/(n-2) AS skew, ((n+1)*(m4/(m2*m2)-3)+6)*(n-1.0)/((n-2.0)*(n-3.0))+3 AS kurtosis, n >= 100 AS enough FROM (
SELECT trial, count(*) AS n, any_value(m) AS mean, stddev_samp(net) AS sd, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
 avg(power(net-m,2)) AS m2, avg(power(net-m,3)) AS m3, avg(power(net-m,4)) AS m4 FROM (SELECT *, avg(net) OVER (PARTITION BY trial) AS m FROM streams) GROUP BY trial)""")


@query("AGG-04", "trial #n ~mean ~sd ~sharpe ~hit_rate ~skew ~kurtosis enough", digits=5, parts="summ", sql="SELECT * FROM summ")
def return_summaries(spark, sf):
    return I.summarize(streams(spark, sf), ["trial"], "net")


# Two-sided Student tail for whole degrees of freedom: a finite sum in the cosine of the angle of t.
part("pvals", "hacs", """
WITH a AS (SELECT *, n-1 AS v, atan(abs(t)/sqrt(n-1.0)) AS th FROM hacs),
 s AS (SELECT trial, sum(CASE WHEN v % 2 = 0 THEN exp(lgamma(k+0.5)-lgamma(0.5)-lgamma(k+1.0))*power(cos(th),2*k) ELSE exp(lgamma(k+1.0)+lgamma(1.5)-lgamma(k+1.5))*power(cos(th),2*k+1) END) AS s
  FROM a JOIN (SELECT unnest(generate_series(0,(SELECT max(n) FROM hacs))) AS k) ON k < v // 2 GROUP BY trial)
SELECT a.* EXCLUDE (v, th), round(greatest(0, 1 - CASE WHEN v % 2 = 0 THEN sin(th)*s ELSE 2/pi()*(th + sin(th)*s) END), 12) AS p FROM a JOIN s USING (trial)""")


def p_values(spark, sf):
    return I.with_p(tests(spark, sf)).withColumn("p", F.round("p", 12))


@query("STAT-02 STAT-03", "trial ~p ~p_bh reject_bh ~p_bonf reject_bonf", parts="pvals", sql="""
SELECT trial, p, p_bh, p_bh <= 0.05 AS reject_bh, least(1, p*m) AS p_bonf, least(1, p*m) <= 0.05 AS reject_bonf FROM (
SELECT trial, p, count(*) OVER () AS m, least(1, min(raw) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS p_bh FROM (
SELECT *, row_number() OVER (ORDER BY p, trial) AS k, p*count(*) OVER ()/row_number() OVER (ORDER BY p, trial) AS raw FROM pvals))""")
def multiple_testing(spark, sf):
    return I.bonferroni(I.benjamini_hochberg(p_values(spark, sf), "p"), "p")


def metrics(spark, sf):
    def build():
        s = I.summarize(streams(spark, sf), ["trial"], "net").drop("n", "mean")
        return I.deflated(I.with_p(tests(spark, sf).join(s, "trial")))

    return P.kept(spark, sf, "metrics", build)


@query("STAT-08 STAT-09 STAT-25", "trial #n ~unit_sharpe ~sharpe_se ~family_sd", digits=5, parts="summ", sql="""
SELECT trial, n, mean/sd AS unit_sharpe, sqrt((1 - skew*mean/sd + (kurtosis-1)/4*power(mean/sd,2))/(n-1.0)) AS sharpe_se, stddev_samp(mean/sd) OVER () AS family_sd FROM summ""")
def sharpe_standard_errors(spark, sf):
    m = metrics(spark, sf)
    return m.withColumn("sharpe_se", I.sharpe_error(F.col("unit_sharpe"), F.col("n").cast("double"), F.col("skew"), F.col("kurtosis")))


@query("STAT-08 STAT-09", "trial ~psr ~dsr ~hurdle ~p")
def deflated_sharpe_ratios(spark, sf):
    return metrics(spark, sf)


@query("STAT-13", "trial ~p_gate ~p_bh gate_sample gate_sign gate_t gate_fdr gate_dsr survivor")
def discovery_gauntlet(spark, sf):
    """The declared gates: Student-t p with its family-wide rate, and the deflated Sharpe ratio."""
    return I.gauntlet(metrics(spark, sf))


@query("STAT-18", "trial ~estimate ~reliability ~shrunk", digits=7, parts="hacs", sql="""
SELECT trial, mean AS estimate, tau/(tau+se*se) AS reliability, g + tau/(tau+se*se)*(mean-g) AS shrunk FROM (
SELECT *, avg(mean) OVER () AS g, greatest(var_samp(mean) OVER () - avg(se*se) OVER (), 0) AS tau FROM hacs)""")
def empirical_bayes(spark, sf):
    x = tests(spark, sf).withColumn("estimate", F.col("mean")).withColumn("v", F.col("se") ** 2)
    return I.shrink(x, "estimate", "v")


@query("STAT-17", "trial #n ~mean_on ~mean_off ~slope ~se ~t", digits=5, parts="streams mkt", sql="""
WITH r AS (SELECT session, pos, coalesce(lag(lvl > avg20) OVER (ORDER BY pos), false) AS on_, lag(avg20) OVER (ORDER BY pos) IS NOT NULL AS known FROM (
  SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(lvl) OVER w END AS avg20 FROM (SELECT session, pos, round(sum(coalesce(mkt,0)) OVER (ORDER BY pos), 9) AS lvl FROM mkt) WINDOW w AS (ORDER BY pos ROWS 19 PRECEDING))),
 x AS (SELECT s.trial, s.net AS v, CAST(r.on_ AS DOUBLE) AS d, row_number() OVER (PARTITION BY s.trial ORDER BY s.pos) AS i FROM streams s JOIN r ON r.pos = s.pos WHERE known),
 f AS (SELECT trial, count(*) AS n, avg(d) AS md, avg(v) AS mv, covar_pop(d,v)/var_pop(d) AS slope, var_pop(d) AS vd, avg(v) FILTER (d=1) AS mean_on, avg(v) FILTER (d=0) AS mean_off,
  CAST(floor(4*power(count(*)/100.0,2.0/9.0)) AS BIGINT) AS lags FROM x GROUP BY trial),
 sc AS (SELECT x.trial, i, (d-md)*(v-mv-slope*(d-md)) AS s FROM x JOIN f USING (trial)),
 g AS (SELECT a.trial, l.k, sum(a.s*b.s) AS gk FROM sc a JOIN f USING (trial) JOIN (SELECT unnest(generate_series(0,12)) AS k) l ON l.k <= f.lags JOIN sc b ON b.trial = a.trial AND b.i = a.i - l.k GROUP BY a.trial, l.k)
SELECT f.trial, any_value(n) AS n, any_value(mean_on) AS mean_on, any_value(mean_off) AS mean_off, any_value(slope) AS slope,
 sqrt(sum(CASE WHEN k = 0 THEN gk ELSE 2*(1-k/(lags+1.0))*gk END)/any_value(n)/any_value(n))/any_value(vd) AS se,
 any_value(slope)/(sqrt(sum(CASE WHEN k = 0 THEN gk ELSE 2*(1-k/(lags+1.0))*gk END)/any_value(n)/any_value(n))/any_value(vd)) AS t FROM f JOIN g ON g.trial = f.trial GROUP BY f.trial""")
def regime_interactions(spark, sf):
    return I.regime_interaction(streams(spark, sf).join(market_regime(spark, sf), "pos"), ["trial"], "pos", "net", "on")


def market_regime(spark, sf):
    """Equal-weight market above its own 20-session mean, lagged one session; known rows only."""
    def build():
        one = W.partitionBy(F.lit(1)).orderBy("pos")
        m = FE.market_return(P.with_returns(spark, sf)).withColumn("lvl", F.round(F.sum(F.coalesce("mkt", F.lit(0.0))).over(one), 9))
        w = one.rowsBetween(-19, 0)
        m = m.withColumn("avg20", F.when(F.count("*").over(w) == 20, F.avg("lvl").over(w)))
        m = m.select("pos", F.coalesce(F.lag(F.col("lvl") > F.col("avg20")).over(one), F.lit(False)).alias("on"), F.lag("avg20").over(one).alias("a"))
        return m.where("a is not null").drop("a")

    return P.kept(spark, sf, "market_regime", build)


@query("STAT-19 STAT-20 PRT-22", "trial cluster #cluster_size ~weight", parts="streams", sql="""
WITH RECURSIVE e AS (SELECT a.trial AS x, b.trial AS y FROM streams a JOIN streams b ON a.pos = b.pos GROUP BY ALL HAVING abs(corr(a.net, b.net)) >= 0.7),
 reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
 c AS (SELECT x AS trial, min(y) AS cluster FROM reach GROUP BY x)
SELECT trial, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, 1.0/(SELECT count(DISTINCT cluster) FROM c)/count(*) OVER (PARTITION BY cluster) AS weight FROM c""")
def correlation_clusters(spark, sf):
    from ..operators.clusters import cluster_weights, clusters

    return P.kept(spark, sf, "clusters", lambda: cluster_weights(clusters(streams(spark, sf), "trial", "pos", "net", 0.7)))


@query("PRT-22", "session ~composite", parts="streams", sql="""
WITH RECURSIVE e AS (SELECT a.trial AS x, b.trial AS y FROM streams a JOIN streams b ON a.pos = b.pos GROUP BY ALL HAVING abs(corr(a.net, b.net)) >= 0.7),
 reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
 c AS (SELECT x AS trial, min(y) AS cluster FROM reach GROUP BY x),
 w AS (SELECT trial, 1.0/(SELECT count(DISTINCT cluster) FROM c)/count(*) OVER (PARTITION BY cluster) AS weight FROM c)
SELECT session, sum(net*weight) AS composite FROM streams JOIN w USING (trial) GROUP BY session""")
def composite_stream(spark, sf):
    return streams(spark, sf).join(correlation_clusters(spark, sf), "trial").groupBy("session").agg(
        F.sum(F.col("net") * F.col("weight")).alias("composite"))
