"""Signals of traded proxies with their peers and reference series; the decision that follows from them."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import inference as I
from ..operators import proxies as PX
from ..sources import panel as P
from .catalog import query
from .inference import hac_sql
from .oracle_parts import part

DAILY = {"1-URGENT": "wti", "2-HIGH": "brent", "3-MEDIUM": "ovx", "4-NOT SPECIFIED": "dollar", "5-LOW": "rate"}

part("observed", "", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'wti' WHEN '2-HIGH' THEN 'brent' WHEN '3-MEDIUM' THEN 'ovx' WHEN '4-NOT SPECIFIED' THEN 'dollar' ELSE 'rate' END AS series,
 CAST(o_orderdate AS DATE) + 1 AS usable, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY ALL
UNION ALL SELECT s, CAST(w + k AS DATE), CASE s WHEN 'crude' THEN crude WHEN 'cushing' THEN cushing ELSE managed END FROM (
 SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS w, sum(l_quantity) AS crude, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS cushing, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS managed FROM lineitem GROUP BY 1)
 CROSS JOIN (VALUES ('crude', 9), ('cushing', 9), ('managed', 4)) t(s, k)""")


def observations(spark, sf):
    """Five daily series (one per priority, usable the next morning) and three weekly ones (stocks on the Wednesday of
    the week after, positions on the Friday of the week), from all orders and all lines."""
    name = F.create_map(*[F.lit(x) for pair in DAILY.items() for x in pair])
    o = P.table(spark, sf, "orders").groupBy(F.coalesce(name[F.col("o_orderpriority")], F.lit("rate")).alias("series"), F.to_date("o_orderdate").alias("d"))
    daily = o.agg(F.round(F.avg("o_totalprice"), 6).alias("value")).select("series", "value", clock.new_york_instant(F.date_add("d", 1), 8).alias("available_at"))
    q = F.col("l_quantity")
    weeks = P.table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("w")).agg(
        F.sum(q).alias("crude"), F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", q)), F.lit(0.0)).alias("cushing"),
        F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(-q)).alias("managed"))
    stock, held = clock.new_york_instant(F.date_add("w", 9), 10, 30), clock.new_york_instant(F.date_add("w", 4), 15, 30)
    weekly = weeks.select(F.inline(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).alias("value"), at.alias("available_at"))
                                            for n, at in (("crude", stock), ("cushing", stock), ("managed", held))])))
    return daily.unionByName(weekly)


def peer_table(spark, sf):
    """The next two symbols of a symbol's sector, in a circle."""
    names = P.bars(spark, sf).select("symbol", "sector").distinct()
    w = W.partitionBy("sector").orderBy("symbol")
    placed = names.select("symbol", "sector", F.row_number().over(w).alias("k"), F.count("*").over(W.partitionBy("sector")).alias("n"))
    ahead = placed.select("symbol", "sector", F.explode(F.array(*[(F.col("k") - 1 + F.lit(j)) % F.col("n") + 1 for j in (1, 2)])).alias("k"))
    return ahead.join(placed.select("sector", "k", F.col("symbol").alias("peer")), ["sector", "k"]).where("peer <> symbol").select("symbol", "peer").distinct()


def frame(spark, sf):
    def build():
        known = PX.known_series(P.calendar(spark, sf), observations(spark, sf))
        return PX.signal_frame(P.placed(spark, sf), peer_table(spark, sf), known)

    return P.kept(spark, sf, "proxy_frame", build)


part("known", "cal observed", """
SELECT c.session, max(o.value) FILTER (s = 'wti') AS wti, max(o.value) FILTER (s = 'brent') AS brent, max(o.value) FILTER (s = 'ovx') AS ovx, max(o.value) FILTER (s = 'dollar') AS dollar,
 max(o.value) FILTER (s = 'crude') AS crude, max(o.value) FILTER (s = 'cushing') AS cushing, max(o.value) FILTER (s = 'managed') AS managed
FROM (SELECT session, s FROM cal CROSS JOIN (VALUES ('wti'),('brent'),('ovx'),('dollar'),('crude'),('cushing'),('managed')) t(s)) c
ASOF LEFT JOIN observed o ON o.series = c.s AND c.session >= o.usable GROUP BY c.session""")
part("confirmed", "rets syms", """
WITH k AS (SELECT symbol, sector, row_number() OVER (PARTITION BY sector ORDER BY symbol) AS k, count(*) OVER (PARTITION BY sector) AS n FROM syms),
 pr AS (SELECT DISTINCT a.symbol, b.symbol AS peer FROM k a JOIN k b ON b.sector = a.sector AND b.symbol <> a.symbol AND b.k IN (a.k % a.n + 1, (a.k + 1) % a.n + 1))
SELECT symbol, session, bool_and(coalesce(up, false)) AS rising FROM (
 SELECT p.symbol, p.session, o.px / lag(o.px, 5) OVER (PARTITION BY p.symbol, pr.peer ORDER BY p.session) - 1 > 0 AS up
 FROM rets p JOIN pr ON pr.symbol = p.symbol LEFT JOIN rets o ON o.symbol = pr.peer AND o.session = p.session WHERE p.px IS NOT NULL) GROUP BY ALL""")
part("proxy_frame", "rets known confirmed", """
SELECT *, coalesce(t60 AND e, false) AS ct, coalesce(m20 AND bw AND e AND ob AND dd, false) AS cf FROM (
SELECT r.symbol, r.session, r.pos, r.px, r.open_adj, k.ovx, k.dollar,
 CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN px > avg(px) OVER (w ROWS 19 PRECEDING) END AS t20, CASE WHEN count(*) OVER (w ROWS 59 PRECEDING) = 60 THEN px > avg(px) OVER (w ROWS 59 PRECEDING) END AS t60,
 CASE WHEN count(*) OVER (w ROWS 199 PRECEDING) = 200 THEN px > avg(px) OVER (w ROWS 199 PRECEDING) END AS t200,
 px/lag(px,5) OVER w - 1 > 0 AS m5, px/lag(px,20) OVER w - 1 > 0 AS m20, px/lag(px,60) OVER w - 1 > 0 AS m60, px/lag(px,1) OVER w - 1 < 0 AS r1, px/lag(px,5) OVER w - 1 < 0 AS r5,
 brent/lag(brent,20) OVER w - 1 > wti/lag(wti,20) OVER w - 1 AND wti > 0 AND brent > 0 AS bw, c.rising AS e,
 CASE WHEN count(ovx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 252 THEN ovx < quantile_cont(ovx, 0.9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS ob,
 CASE WHEN count(ovx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 252 THEN ovx > quantile_cont(ovx, 0.9) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS volatile,
 dollar/nullif(lag(dollar,20) OVER w, 0) - 1 AS d20, dollar/nullif(lag(dollar,20) OVER w, 0) - 1 < 0 AS dd, crude - lag(crude) OVER w < 0 AS cd, cushing - lag(cushing) OVER w < 0 AS hd, managed - lag(managed) OVER w > 0 AS mm, isodow(session) = 2 AS tu,
 lead(open_adj) OVER w AS entry, lead(px, 1) OVER w AS x1, lead(px, 3) OVER w AS x3, lead(px, 5) OVER w AS x5, lead(pos, 1) OVER w AS p1, lead(pos, 3) OVER w AS p3, lead(pos, 5) OVER w AS p5,
 px/lag(px,5) OVER w - 1 AS five, CASE WHEN count(*) OVER (w ROWS 60 PRECEDING) = 61 THEN px > avg(px) OVER (w ROWS 60 PRECEDING) END AS t61
FROM rets r LEFT JOIN known k USING (session) LEFT JOIN confirmed c USING (symbol, session) WHERE r.px IS NOT NULL WINDOW w AS (PARTITION BY r.symbol ORDER BY r.session))""")
_ON = " UNION ALL ".join(f"SELECT symbol, '{name}' AS signal, entry, x1, x3, x5, p1, p3, p5 FROM proxy_frame WHERE {flag}" for name, flag in zip(
    PX.SIGNALS, "t20 t60 t200 m5 m20 m60 r1 r5 bw e ob dd cd hd mm tu ct cf".split(), strict=True))
part("proxy_trials", "proxy_frame", f"""
SELECT symbol, signal, horizon, pos, gross, gross - 0.002 AS net FROM (SELECT symbol, signal, h AS horizon, CASE n WHEN 1 THEN p1 WHEN 3 THEN p3 ELSE p5 END AS pos, CASE n WHEN 1 THEN x1 WHEN 3 THEN x3 ELSE x5 END / entry - 1 AS gross
 FROM ({_ON}) CROSS JOIN (VALUES ('INTRADAY', 1), ('SWING_1D', 1), ('SWING_3D', 3), ('SWING_5D', 5)) t(h, n)) WHERE gross IS NOT NULL""")


def trials(spark, sf):
    return P.kept(spark, sf, "proxy_trials", lambda: PX.proxy_trials(frame(spark, sf)))


@query("PRT-16", "symbol session " + " ".join(PX.SIGNALS), parts="proxy_frame", sql="SELECT symbol, session, " + ", ".join(f"coalesce({flag}, false) AS {name}" for name, flag in zip(
    PX.SIGNALS, "t20 t60 t200 m5 m20 m60 r1 r5 bw e ob dd cd hd mm tu ct cf".split(), strict=True)) + " FROM proxy_frame")
def proxy_signals(spark, sf):
    """All eighteen declared signals of every proxy on each of its sessions."""
    return frame(spark, sf)


@query("PRT-16", "symbol signal horizon #n ~mean_gross ~mean_net ~hit_rate ~sd", parts="proxy_trials", sql="""
SELECT symbol, signal, horizon, count(*) AS n, avg(gross) AS mean_gross, avg(net) AS mean_net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, stddev_samp(net) AS sd FROM proxy_trials GROUP BY ALL""")
def proxy_signal_study(spark, sf):
    """Eighteen signals by four horizons on every proxy, after the round-trip cost."""
    return trials(spark, sf).groupBy("symbol", "signal", "horizon").agg(
        F.count("*").alias("n"), F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.stddev_samp("net").alias("sd"))


@query("PRT-16 STAT-01", "signal horizon #n ~mean ~t", digits=5, parts="proxy_trials", sql=f"""
WITH pool AS (SELECT signal, horizon, pos, avg(net) AS v FROM proxy_trials GROUP BY ALL), {hac_sql("SELECT * FROM pool", "signal, horizon", 5)}
SELECT signal, horizon, n, mean, t FROM hac""")
def proxy_signal_tests(spark, sf):
    """Each of the 72 declared trials as one stream, the proxies of a session averaged, with a mean test."""
    pooled = trials(spark, sf).groupBy("signal", "horizon", "pos").agg(F.avg("net").alias("net"))
    return I.hac(pooled, ["signal", "horizon"], "pos", "net", holding=5)


@query("PRT-17", "symbol sector #n_proxies #rising agreement horizon #votes vetoes status", parts="proxy_frame syms stop_gaps lanes", sql="""
WITH four AS (SELECT symbol, sector FROM syms QUALIFY row_number() OVER (PARTITION BY sector ORDER BY symbol) <= 4),
 v AS (SELECT * FROM proxy_frame QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) = 1),
 st AS (SELECT sector, count(five) AS n_proxies, count(*) FILTER (five > 0) AS rising, count(DISTINCT session) = 1 AS same FROM four JOIN v USING (symbol) GROUP BY sector),
 x AS (SELECT *, CASE WHEN n_proxies <> 4 THEN 'DATA_UNAVAILABLE' WHEN rising >= 3 THEN 'BULLISH' WHEN rising <= 1 THEN 'BEARISH' ELSE 'MIXED' END AS agreement FROM four JOIN v USING (symbol) JOIN st USING (sector)
  LEFT JOIN (SELECT symbol, count(*) FILTER (status = 'READY') AS ready FROM lanes GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, gap_atr FROM stop_gaps) USING (symbol)),
 y AS (SELECT *, coalesce(t61, false)::INT + coalesce(m20, false)::INT + (agreement = 'BULLISH')::INT + coalesce(d20 <= 0, false)::INT AS votes FROM x),
 z AS (SELECT symbol, sector, n_proxies, rising, agreement, horizon, votes, concat_ws(',', CASE WHEN agreement = 'DATA_UNAVAILABLE' OR NOT same THEN 'PROXY_BARS' END, CASE WHEN ovx IS NULL OR dollar IS NULL THEN 'REFERENCES' END,
  CASE WHEN coalesce(ready, 0) = 0 THEN 'NO_LANE' END, CASE WHEN gap_atr > 1.5 THEN 'ENTRY_GAP' END, CASE WHEN volatile THEN 'VOLATILITY_HIGH' END, CASE WHEN agreement <> 'BULLISH' THEN 'PROXY_AGREEMENT' END,
  CASE WHEN votes < 3 THEN 'COMPOSITE_ABSENT' END, CASE WHEN horizon = 'SWING_3D' AND isodow(session) IN (2, 3, 4) THEN 'CROSSES_WEEKEND' END) AS vetoes FROM y CROSS JOIN (VALUES ('INTRADAY'), ('SWING_3D')) t(horizon))
SELECT *, CASE WHEN vetoes = '' THEN 'WATCH' ELSE 'NO_TRADE' END AS status FROM z""")
def proxy_decisions(spark, sf):
    """For every symbol with its sector's first four symbols as proxies: agreement, four votes, lanes, vetoes, status."""
    from .scalars import risk_lanes
    from .windows import stop_and_gap_risk

    votes = PX.composite_votes(frame(spark, sf))
    names = P.bars(spark, sf).select("symbol", "sector").distinct()
    four = names.withColumn("k", F.row_number().over(W.partitionBy("sector").orderBy("symbol"))).where("k <= 4")
    groups = four.select(F.col("sector").alias("group"), "symbol")
    ready = risk_lanes(spark, sf).groupBy("symbol").agg(F.count_if(F.col("status") == "READY").alias("ready"))
    x = PX.agreement(votes, groups).join(ready, "symbol", "left").join(stop_and_gap_risk(spark, sf).select("symbol", "gap_atr"), "symbol", "left")
    # In at the next session, out three sessions later: a signal of Tuesday to Thursday is held over a weekend.
    crosses = F.weekday("session").isin(1, 2, 3)
    return PX.horizon_decisions(x, crosses).withColumnRenamed("group", "sector")
