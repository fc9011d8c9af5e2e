"""Portfolio studies."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import costs as K
from ..operators import cohorts as CO
from ..operators import crosssec as X
from ..operators import episodes as EP
from ..operators import features as FE
from ..operators import inference as I
from ..operators import membership as M
from ..operators import monthly as MO
from ..operators import placebo as PL
from ..operators import portfolio as PO
from ..operators import streams as S
from ..operators.frames import framed, shifted
from ..sources import panel as P
from .catalog import query
from .inference import hac_sql, market, market_regime, metrics, signals, streams
from .oracle_parts import part
from .tops import monthly_top_fraction, rev5


def deciles(spark, sf):
    return P.kept(spark, sf, "deciles", lambda: X.decile_weights(rev5(spark, sf), "rev"))


part("book", "deciles rets", "SELECT r.session, r.pos, CASE WHEN count(r.ret) > 0 THEN sum(coalesce(d.weight*r.ret,0)) END AS gross FROM deciles d JOIN rets r ON r.symbol = d.symbol AND r.pos = d.pos + 2 WHERE d.weight <> 0 GROUP BY ALL")


@query("PRT-02 AGG-01 WIN-41", "session ~gross", parts="book", sql="SELECT session, gross FROM book")
def decile_long_short_stream(spark, sf):
    return PO.lagged_book(deciles(spark, sf), P.grid(spark, sf), 2)


@query("WIN-05 TOP-02 AGG-04", "#year #n ~mean ~sharpe", digits=5, parts="book", sql="SELECT year(session) AS year, count(gross) AS n, avg(gross) AS mean, avg(gross)/stddev_samp(gross)*sqrt(252.0) AS sharpe FROM book GROUP BY 1")
def decile_reversal_by_year(spark, sf):
    x = decile_long_short_stream(spark, sf).withColumn("year", F.year("session"))
    return I.summarize(x, ["year"], "gross")


@query("PRT-04", "session ~signal", parts="flags", sql="SELECT session, CASE WHEN opex_week THEN -1.0 ELSE 0.0 END AS signal FROM flags")
def event_mask_signal(spark, sf):
    return P.calendar_table(spark, sf).withColumn("signal", F.when(F.col("opex_week"), -1.0).otherwise(0.0))


# Legs of the equal-weight market per session convention, and one row per (hypothesis, session).
part("legs", "rets", """
SELECT pos, session, 'CLOSE_TO_CLOSE' AS leg, avg(ret) AS r FROM rets GROUP BY ALL UNION ALL SELECT pos, session, 'OVERNIGHT', avg(open_adj/px1-1) FROM rets GROUP BY ALL UNION ALL SELECT pos, session, 'INTRADAY', avg(px/open_adj-1) FROM rets GROUP BY ALL""")


def market_legs(spark, sf):
    r = P.grid(spark, sf)
    x = r.groupBy("pos", "session").agg(F.avg("ret").alias("c"), F.avg(F.col("open_adj") / F.col("px1") - 1).alias("o"), F.avg(F.col("px") / F.col("open_adj") - 1).alias("i"))
    return x.select("pos", "session", F.inline(F.array(*[F.struct(F.lit(n).alias("leg"), F.col(c).alias("r")) for n, c in (("CLOSE_TO_CLOSE", "c"), ("OVERNIGHT", "o"), ("INTRADAY", "i"))])))


@query("PRT-05 FUN-18 PRT-03", "trial #n ~mean ~total", digits=5, parts="legs flags", sql="""
WITH f AS (SELECT pos, 'weekday' AS family, CAST(weekday AS VARCHAR) AS value FROM flags UNION ALL SELECT pos, 'month', CAST(month AS VARCHAR) FROM flags UNION ALL SELECT pos, 'opex', 'WEEK' FROM flags WHERE opex_week
 UNION ALL SELECT pos, 'turn_of_month', CASE WHEN turn_of_month THEN 'TOM' ELSE 'REST' END FROM flags UNION ALL SELECT pos, 'holiday', 'PRE' FROM flags WHERE pre_holiday UNION ALL SELECT pos, 'holiday', 'POST' FROM flags WHERE post_holiday
 UNION ALL SELECT pos, 'event', 'DAY_BEFORE' FROM flags WHERE event_day_before UNION ALL SELECT pos, 'event', 'DAY_OF' FROM flags WHERE event_day_of UNION ALL SELECT pos, 'event', 'EVENT_WEEK' FROM flags WHERE event_week
 UNION ALL SELECT pos, 'month_end', CASE WHEN month_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags UNION ALL SELECT pos, 'quarter_end', CASE WHEN quarter_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags),
 h AS (SELECT 'ANY' AS h, pos FROM flags UNION ALL SELECT family || '=' || value, pos FROM f UNION ALL SELECT a.family || '=' || a.value || '&' || b.family || '=' || b.value, a.pos FROM f a JOIN f b ON a.pos = b.pos AND a.family < b.family),
 p AS (SELECT h, pos, leg, holding FROM h CROSS JOIN (VALUES ('CLOSE_TO_CLOSE',1),('CLOSE_TO_CLOSE',3),('CLOSE_TO_CLOSE',5),('CLOSE_TO_CLOSE',21),('OVERNIGHT',1),('INTRADAY',1)) l(leg,holding)),
 e AS (SELECT DISTINCT h, leg, holding, pos + k AS pos FROM p, (SELECT unnest(generate_series(0,20)) AS k) WHERE k < holding AND pos + k >= 2)
SELECT h || '|' || e.leg || '|' || holding || '|' || d AS trial, count(r) AS n, avg(r*s) AS mean, sum(r*s) AS total FROM e JOIN legs ON legs.pos = e.pos AND legs.leg = e.leg CROSS JOIN (VALUES ('LONG',1),('SHORT',-1)) d(d,s) GROUP BY ALL HAVING count(r) > 0""")
def calendar_trial_grid(spark, sf):
    from ..operators.hypotheses import calendar_trials

    return calendar_trials(spark, P.calendar_table(spark, sf), market_legs(spark, sf), P.calendar(spark, sf))


@query("PRT-06 PRT-07", "trial session ~gross ~cost ~net", digits=5)
def fill_limited_reversal(spark, sf):
    e = S.reversal_entries(signals(spark, sf), (5,), ("raw",)).where("trial like '%LONG'")
    want = S.positions(e, 5, 2)
    life = want.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    names = want.select("trial", "symbol").distinct().join(F.broadcast(life))
    rows = names.select("trial", "symbol", F.explode(F.sequence("lo", "hi")).alias("pos")).join(want.select("trial", "symbol", "pos", (F.col("weight") / 2).alias("desired")), ["trial", "symbol", "pos"], "left")
    m = market(spark, sf)
    rows = rows.join(m.select("symbol", "pos", (F.col("volume") > 0).alias("tradable")), ["symbol", "pos"], "left").select("trial", "symbol", "pos", F.coalesce("desired", F.lit(0.0)).alias("desired"), F.coalesce("tradable", F.lit(False)).alias("tradable"))
    held = PO.fill_limited(rows, 0.5)
    both = held.select("trial", "symbol", "pos", "weight", F.lit(0.0).alias("previous")).unionByName(
        held.select("trial", "symbol", (F.col("pos") + 1).alias("pos"), F.lit(0.0).alias("weight"), F.col("weight").alias("previous")))
    pos = both.groupBy("trial", "symbol", "pos").agg(F.sum("weight").alias("weight"), F.sum("previous").alias("previous"))
    return S.evaluate(pos, m, P.calendar(spark, sf))


part("sel", "rev5 cal", """
SELECT s.symbol, s.session, k.k, k.pos, k.next_pos FROM (SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS r, floor(count(*) OVER (PARTITION BY session)/5) AS names FROM rev5 WHERE rev IS NOT NULL AND asset_type = 'equity') s
JOIN (SELECT session, pos, row_number() OVER (ORDER BY session) AS k, lead(pos) OVER (ORDER BY session) AS next_pos FROM cal WHERE session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))) k USING (session) WHERE r <= names AND names >= 2""")


@query("PRT-09 WIN-46 ASM-12", "session ~gross", parts="sel rets", sql="""
SELECT session, sum(d*r)/sum(d) AS gross FROM (SELECT *, coalesce(exp(sum(ln(1+r)) OVER (PARTITION BY k, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),1) AS d FROM (
SELECT s.k, s.symbol, t.pos, t.session, coalesce(t.ret,0) AS r FROM sel s JOIN rets t ON t.symbol = s.symbol AND t.pos > s.pos AND t.pos <= s.next_pos)) GROUP BY session""")
def monthly_cross_section_study(spark, sf):
    ends = MO.numbered_month_ends(P.calendar(spark, sf))
    x = MO.study(monthly_top_fraction(spark, sf), ends, market(spark, sf), P.calendar(spark, sf))
    return x.where("gross is not null")


# Study, feature, one name of how many; the lowest risk ranks first.
MONTHLY_STUDIES = (
    ("mom_12_1_top_decile", "m12", 10), ("mom_12_1_top_quintile", "m12", 5), ("mom_6_1_top_decile", "m6", 10),
    ("nearness_top_decile", "near", 10), ("nearness_top_quintile", "near", 5),
    ("volume_shock_top_decile", "shock", 10), ("volume_shock_top_quintile", "shock", 5),
    ("vol_252_bottom_decile", "v252", 10), ("vol_63_bottom_decile", "v63", 10), ("beta_252_bottom_decile", "beta", 10),
)
part("monthly_books", "rets mkt cal", f"""
WITH r AS (SELECT r.*, m.mkt FROM rets r JOIN mkt m USING (session, pos)),
 f AS (SELECT symbol, session, pos, ret, asset_type, px21/px252 - 1 AS m12, px21/px126 - 1 AS m6, lag(near) OVER (PARTITION BY symbol ORDER BY pos) AS near, v5/v60 AS shock, v252, v63, beta FROM (
  SELECT *, lag(px,21) OVER w AS px21, lag(px,252) OVER w AS px252, lag(px,126) OVER w AS px126, CASE WHEN count(px) OVER (w ROWS 251 PRECEDING) = 252 THEN px/max(px) OVER (w ROWS 251 PRECEDING) END AS near,
  CASE WHEN count(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 THEN avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS v5, CASE WHEN count(volume) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) = 60 THEN avg(volume) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS v60,
  CASE WHEN count(ret) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) = 252 THEN -(stddev_samp(ret) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) END AS v252, CASE WHEN count(ret) OVER (w ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN -(stddev_samp(ret) OVER (w ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) END AS v63,
  CASE WHEN count(ret) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) = 252 THEN -(covar_samp(ret, mkt) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)/var_samp(mkt) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) END AS beta FROM r WINDOW w AS (PARTITION BY symbol ORDER BY pos))),
 m AS (SELECT session, pos, row_number() OVER (ORDER BY session) AS k, lead(pos) OVER (ORDER BY session) AS next_pos FROM cal WHERE session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))),
 l AS ({" UNION ALL ".join(f"SELECT '{study}' AS study, {d} AS denominator, symbol, session, {feature} AS v FROM f WHERE ret IS NOT NULL AND asset_type = 'equity' AND {feature} IS NOT NULL" for study, feature, d in MONTHLY_STUDIES)}),
 sel AS (SELECT study, k, pos, next_pos, symbol FROM (SELECT l.*, m.k, m.pos, m.next_pos, row_number() OVER (PARTITION BY study, k ORDER BY v DESC, symbol) AS r, floor(count(*) OVER (PARTITION BY study, k)/denominator) AS names FROM l JOIN m USING (session)) WHERE r <= names AND names >= 1)
SELECT study, session, sum(w*r)/sum(w) AS gross FROM (SELECT *, coalesce(product(1+r) OVER (PARTITION BY study, k, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS w FROM (
 SELECT s.study, s.k, s.symbol, t.pos, t.session, coalesce(t.ret,0) AS r FROM sel s JOIN rets t ON t.symbol = s.symbol AND t.pos > s.pos AND t.pos <= s.next_pos)) GROUP BY study, session""")


def monthly_books(spark, sf):
    def build():
        m, cal = market(spark, sf), P.calendar(spark, sf)
        r = P.with_returns(spark, sf)
        x = r.join(FE.market_return(r).select("pos", "mkt"), "pos").withColumns({
            "m12": FE.momentum(252, 21), "m6": FE.momentum(126, 21), "_near": FE.high_proximity(252), "shock": FE.volume_shock(),
            "v252": -framed(F.stddev_samp("ret"), "ret", 252, end=-1), "v63": -framed(F.stddev_samp("ret"), "ret", 63, end=-1),
            "beta": -(framed(F.covar_samp("ret", "mkt"), "ret", 252, end=-1) / framed(F.var_samp("mkt"), "ret", 252, end=-1))})
        x = x.withColumn("near", shifted("_near", 1)).where("asset_type = 'equity' and ret is not null")
        one = F.array(*[F.struct(F.lit(n).alias("study"), F.lit(d).alias("denominator"), F.col(c).alias("v")) for n, c, d in MONTHLY_STUDIES])
        rows = X.month_end_rows(x, cal).select("symbol", "session", F.inline(one)).where("v is not null")
        return MO.study(X.top_fraction(rows, "v", F.col("denominator"), 1, False, by=("study", "session")), MO.numbered_month_ends(cal), m, cal, by=("study",))

    return P.kept(spark, sf, "monthly_books", build)


@query("PRT-09 ASM-12 SET-01", "study session ~gross", parts="monthly_books", sql="SELECT * FROM monthly_books")
def declared_monthly_books(spark, sf):
    """Ten declared studies: momentum, nearness to the high, volume shock, volatility and beta, gross."""
    return monthly_books(spark, sf).where("gross is not null")


@query("PRT-09 ASM-12 SET-01", "study session ~gross ~cost ~net")
def declared_monthly_studies(spark, sf):
    """The ten studies after per-name change costs."""
    return monthly_books(spark, sf)


MASKS = {"seasonal": "month(session) in (11, 12, 1, 2, 3, 4)", "turn_of_month": "turn_of_month", "pre_holiday": "pre_holiday"}


@query("PRT-10", "study symbol session ~gross ~cost ~net", parts="rets flags", sql="""
WITH x AS (SELECT r.symbol, r.session, r.pos, r.ret, m.study, CASE m.study WHEN 'seasonal' THEN month(r.session) IN (11,12,1,2,3,4) WHEN 'turn_of_month' THEN f.turn_of_month ELSE f.pre_holiday END AS f FROM rets r JOIN flags f ON f.pos = r.pos CROSS JOIN (VALUES ('seasonal'),('turn_of_month'),('pre_holiday')) m(study))
SELECT study, symbol, session, CASE WHEN f THEN coalesce(ret,0) ELSE 0.0 END AS gross, cost, CASE WHEN f THEN coalesce(ret,0) ELSE 0.0 END - cost AS net FROM (
SELECT *, 0.0003*(CASE WHEN f AND NOT coalesce(lag(f) OVER w, false) THEN 1 ELSE 0 END + CASE WHEN f AND NOT coalesce(lead(f) OVER w, false) THEN 1 ELSE 0 END) AS cost FROM x WINDOW w AS (PARTITION BY study, symbol ORDER BY pos))""")
def calendar_mask_studies(spark, sf):
    t = P.calendar_table(spark, sf).select("pos", "turn_of_month", "pre_holiday")
    x = P.grid(spark, sf).select("symbol", "session", "pos", "ret").join(t, "pos")
    x = x.select("symbol", "session", "pos", "ret", F.inline(F.array(*[F.struct(F.lit(n).alias("study"), F.expr(e).alias("flag")) for n, e in MASKS.items()])))
    return PO.mask_stream(x, "flag", "ret", 0.0003, ("study", "symbol"))


TREND_RULES = ("tsmom_12_1", "above_sma200", "above_10m_sma")  # fixed values: the declared rules
_RULES = ",".join(f"('{r}')" for r in TREND_RULES)


@query("PRT-10", "study symbol session ~position ~net", digits=5, parts="rets", sql=f"""
WITH o AS (SELECT symbol, session, pos, px, CASE WHEN count(px) OVER f = 200 THEN round(avg(px) OVER f, 9) END AS a200, row_number() OVER (PARTITION BY symbol, date_trunc('month',session) ORDER BY pos DESC) AS back FROM rets WHERE px IS NOT NULL WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS 199 PRECEDING)),
 e AS (SELECT *, lag(px,1) OVER w AS p1, lag(px,12) OVER w AS p12, CASE WHEN count(*) OVER g = 10 THEN round(avg(px) OVER g, 9) END AS a10 FROM o WHERE back = 1 WINDOW w AS (PARTITION BY symbol ORDER BY pos), g AS (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING)),
 k AS (SELECT symbol, pos, study, CASE WHEN coalesce(CASE study WHEN 'tsmom_12_1' THEN p1/p12 > 1 WHEN 'above_sma200' THEN px > a200 ELSE px > a10 END, false) THEN 1.0 ELSE 0.0 END AS dec FROM e CROSS JOIN (VALUES {_RULES}) s(study)),
 d AS (SELECT r.symbol, r.session, r.pos, r.ret, s.study, k.dec FROM rets r CROSS JOIN (VALUES {_RULES}) s(study) LEFT JOIN k ON k.symbol = r.symbol AND k.pos = r.pos AND k.study = s.study),
 p AS (SELECT *, coalesce(last_value(dec IGNORE NULLS) OVER (PARTITION BY study, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS position FROM d)
SELECT study, symbol, session, position, position*coalesce(ret,0) - 0.0003*abs(position - coalesce(lag(position) OVER (PARTITION BY study, symbol ORDER BY pos),0)) AS net FROM p""")
def trend_studies(spark, sf):
    """The three declared monthly rules of each symbol: 12-1 momentum, 200 sessions, ten month ends."""
    own = W.partitionBy("symbol").orderBy("pos")
    f, back = own.rowsBetween(-199, 0), F.row_number().over(W.partitionBy("symbol", F.trunc("session", "MM")).orderBy(F.col("pos").desc()))
    x = P.placed(spark, sf).select("symbol", "session", "pos", "px", F.when(F.count("px").over(f) == 200, F.round(F.avg("px").over(f), 9)).alias("a200"), back.alias("back")).where("back = 1")
    g = own.rowsBetween(-9, 0)
    ten = F.when(F.count("px").over(g) == 10, F.round(F.avg("px").over(g), 9))
    rules = dict(zip(TREND_RULES, (F.lag("px", 1).over(own) / F.lag("px", 12).over(own) > 1, F.col("px") > F.col("a200"), F.col("px") > ten), strict=True))
    decided = x.select("symbol", "pos", *[F.coalesce(r, F.lit(False)).cast("double").alias(n) for n, r in rules.items()])
    decided = decided.select("symbol", "pos", F.inline(F.array(*[F.struct(F.lit(n).alias("study"), F.col(n).alias("dec")) for n in TREND_RULES])))
    days = P.grid(spark, sf).select("symbol", "session", "pos", "ret", F.explode(F.array(*[F.lit(n) for n in TREND_RULES])).alias("study"))
    w = W.partitionBy("study", "symbol").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    y = days.join(decided, ["study", "symbol", "pos"], "left").withColumn("position", F.coalesce(F.last("dec", True).over(w), F.lit(0.0)))
    return PO.flip_stream(y, "position", "ret", 0.0003, ("study", "symbol")).join(y.select("study", "symbol", "pos", "position"), ["study", "symbol", "pos"])


@query("PRT-11", "trial session ~gross ~net", parts="rets flags mkt", sql="""
WITH o AS (SELECT r.asset_type, r.session, r.pos, avg(open_adj/px1-1) AS r FROM rets r GROUP BY ALL),
 m AS (SELECT pos, round(exp(sum(ln(1+coalesce(mkt,0))) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)), 9) AS lvl, CASE WHEN count(mkt) OVER f = 21 THEN round(stddev_samp(mkt) OVER f, 9) END AS vol FROM mkt WINDOW f AS (ORDER BY pos ROWS 20 PRECEDING)),
 a AS (SELECT pos, vol, CASE WHEN count(lvl) OVER (ORDER BY pos ROWS 199 PRECEDING) = 200 THEN lvl > round(avg(lvl) OVER (ORDER BY pos ROWS 199 PRECEDING), 9) END AS up,
  CASE WHEN count(vol) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 252 THEN quantile_cont(vol, 2.0/3.0) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS thr FROM m),
 st AS (SELECT pos, lag(up) OVER (ORDER BY pos) AS above, lag(vol) OVER (ORDER BY pos) > thr AS high FROM a),
 c AS (SELECT pos, 'ANY' AS cond FROM flags UNION ALL SELECT pos, 'turn_of_month=TOM' FROM flags WHERE turn_of_month UNION ALL SELECT pos, 'month_end_window=WINDOW' FROM flags WHERE month_end_window
  UNION ALL SELECT pos, 'weekday=FRI' FROM flags WHERE weekday = 4 UNION ALL SELECT pos, 'market_above_sma200' FROM st WHERE above UNION ALL SELECT pos, 'market_vol_high_tercile' FROM st WHERE high)
SELECT asset_type || '|' || cond || '|' || d AS trial, session, s*r AS gross, s*r - 0.0006 AS net FROM o JOIN c ON c.pos = o.pos CROSS JOIN (VALUES ('LONG',1.0),('SHORT',-1.0)) d(d,s) WHERE r IS NOT NULL""")
def overnight_family(spark, sf):
    """Six conditions x two groups of instruments x two sides. The state of the market is that of the entry close, one
    session before the interval ends; its threshold is drawn from the values up to then."""
    from ..operators.expanding import expanding_quantiles

    panel = P.with_returns(spark, sf)
    r = panel.groupBy("asset_type", "session", "pos").agg(F.avg(F.col("open_adj") / F.col("px1") - 1).alias("r")).where("r is not null")
    w = W.orderBy("pos")  # the calendar: one row per session
    past, month, long = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(-20, 0), w.rowsBetween(-199, 0)
    m = FE.market_return(panel).select("pos", "mkt").select(
        "pos", F.round(F.exp(F.sum(F.log1p(F.coalesce("mkt", F.lit(0.0)))).over(past)), 9).alias("level"), F.when(F.count("mkt").over(month) == 21, F.round(F.stddev_samp("mkt").over(month), 9)).alias("vol"))
    m = m.withColumn("up", F.when(F.count("level").over(long) == 200, F.col("level") > F.round(F.avg("level").over(long), 9)))
    q = expanding_quantiles(m.withColumn("symbol", F.lit("M")), "vol", {"threshold": 2.0 / 3.0}, 252)
    state = q.select("pos", F.lag("up").over(w).alias("above"), (F.lag("vol").over(w) > F.col("threshold")).alias("high"))
    t = P.calendar_table(spark, sf).select("pos", "turn_of_month", "month_end_window", (F.col("weekday") == 4).alias("friday")).join(state, "pos", "left")
    conds = {"ANY": F.lit(True), "turn_of_month=TOM": "turn_of_month", "month_end_window=WINDOW": "month_end_window", "weekday=FRI": "friday", "market_above_sma200": "above", "market_vol_high_tercile": "high"}
    c = t.select("pos", F.explode(F.array_compact(F.array(*[F.when(F.col(x) if isinstance(x, str) else x, F.lit(n)) for n, x in conds.items()]))).alias("cond"))
    sides = F.array(F.struct(F.lit("LONG").alias("d"), F.lit(1.0).alias("s")), F.struct(F.lit("SHORT").alias("d"), F.lit(-1.0).alias("s")))
    x = r.join(c, "pos").select("*", F.inline(sides))
    return x.select(F.concat_ws("|", "asset_type", "cond", "d").alias("trial"), "session", (F.col("s") * F.col("r")).alias("gross"), (F.col("s") * F.col("r") - 0.0006).alias("net"))


@query("PRT-12", "#cycle a b #pos ~gross ~cost")
def pairs_trading(spark, sf):
    from .tops import closest_pairs

    pairs = closest_pairs(spark, sf).select((F.col("cycle") + 1).alias("cycle"), "a", "b", F.col("sd").alias("sigma"))
    m = market(spark, sf).where("asset_type = 'etf'").withColumn("cycle", F.year("session"))
    own = W.partitionBy("symbol", "cycle").orderBy("pos")
    cost = K.flip_fraction(F.lit(0.1), F.col("adv20"), F.col("asset_type"))
    m = m.select("symbol", "cycle", "pos", (F.col("px") / F.first("px").over(own)).alias("v"), F.coalesce("ret", F.lit(0.0)).alias("ret"), cost.alias("c"))
    side = lambda t: m.select("cycle", "pos", F.col("symbol").alias(t), F.col("v").alias(f"v_{t}"), F.col("ret").alias(f"ret_{t}"), F.col("c").alias(f"c_{t}"))
    days = pairs.join(side("a"), ["cycle", "a"]).join(side("b"), ["cycle", "b", "pos"])
    days = days.select("cycle", "a", "b", "pos", (F.col("v_a") - F.col("v_b")).alias("spread"), "sigma", "ret_a", "ret_b", (F.col("c_a") + F.col("c_b")).alias("leg_cost"))
    return PO.trade_pairs(days, 2.0, 0.1, 0.003 / 365).where("active or cost > 0")


part("tomplan", "cal", """
SELECT month, a.session AS entry, b.session AS exposure, c.session AS n1, d.session AS n2, e.session AS "exit" FROM (SELECT *, lead(n) OVER (ORDER BY month) AS nn FROM (SELECT CAST(date_trunc('month',session) AS DATE) AS month, max(pos) AS p, count(*) AS n FROM cal GROUP BY 1)) m
JOIN cal a ON a.pos = m.p-1 JOIN cal b ON b.pos = m.p JOIN cal c ON c.pos = m.p+1 JOIN cal d ON d.pos = m.p+2 JOIN cal e ON e.pos = m.p+3 WHERE nn >= 3""")
part("tomeps", "tomplan bars", """
SELECT *, p1/p0-1 AS gross, p1/p0*(1-c0)*(1-c1)-1 AS net, p1/p0*(1-4*c0)*(1-4*c1)-1 AS net_4x FROM (
SELECT x.symbol, t.month, t.entry, t."exit", x.adjusted_close AS p0, y.adjusted_close AS p1, (1.5+least(1+10*sqrt(10000.0/greatest(x.close*x.volume,1000000.0)),50))/10000 AS c0, (1.5+least(1+10*sqrt(10000.0/greatest(y.close*y.volume,1000000.0)),50))/10000 AS c1
FROM tomplan t JOIN bars x ON x.session = t.entry JOIN bars y ON y.session = t."exit" AND y.symbol = x.symbol WHERE (SELECT count(*) FROM bars z WHERE z.symbol = x.symbol AND z.session IN (t.exposure, t.n1, t.n2)) = 3)""")


def tom_episodes(spark, sf):
    return P.kept(spark, sf, "tomeps", lambda: EP.episodes(P.bars(spark, sf), EP.plan(P.calendar(spark, sf))))


@query("PRT-13", "symbol month entry exit ~gross ~cost_bps ~net ~net_4x", parts="tomeps", sql='SELECT symbol, month, entry, "exit", gross, (c0+c1)*10000 AS cost_bps, net, net_4x FROM tomeps')
def turn_of_month_episodes(spark, sf):
    return tom_episodes(spark, sf)


@query("PRT-14", "symbol #n ~mean ~mean_4x ~hit ~positive_years gate_sample gate_costs gate_years", digits=5, parts="tomeps", sql="""
SELECT e.symbol, count(*) AS n, avg(net) AS mean, avg(net_4x) AS mean_4x, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit, any_value(py) AS positive_years, count(*) >= 12 AS gate_sample, avg(net_4x) > 0 AS gate_costs, any_value(py) >= 0.6 AS gate_years FROM tomeps e
JOIN (SELECT symbol, avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END) AS py FROM (SELECT symbol, product(1+net)-1 AS a FROM tomeps GROUP BY symbol, year("exit")) GROUP BY symbol) y USING (symbol) GROUP BY e.symbol""")
def episode_gates(spark, sf):
    return EP.evaluate(tom_episodes(spark, sf))


@query("PRT-15", "entry exposure exit", parts="tomplan", sql="""SELECT entry, exposure, "exit" FROM tomplan WHERE entry > DATE '2000-03-10' ORDER BY entry LIMIT 1""")
def next_known_trade(spark, sf):
    return EP.upcoming(EP.plan(P.calendar(spark, sf)), "2000-03-10")


@query("PRT-16", "signal symbol #horizon #n ~mean", digits=5, parts="rets mkt", sql="""
WITH q AS (SELECT pos, CASE WHEN count(x) OVER f >= 252 THEN quantile_cont(x, 0.9) OVER f END AS hi, x FROM (SELECT pos, round(abs(mkt),9) AS x FROM mkt) WINDOW f AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT pos, 'SHOCK' AS signal FROM q WHERE x > hi UNION ALL SELECT pos, 'CALM' FROM q WHERE x <= hi)
SELECT signal, symbol, horizon, count(*) AS n, avg(ret) AS mean FROM (SELECT s.signal, r.symbol, h AS horizon, lead(r.px,h) OVER w/lead(r.open_adj,1) OVER w - 1 AS ret, s.pos IS NOT NULL AS k FROM rets r CROSS JOIN (VALUES (1),(3),(5),(10)) t(h) LEFT JOIN s ON s.pos = r.pos WHERE r.asset_type = 'etf'
 WINDOW w AS (PARTITION BY r.symbol, h ORDER BY r.pos)) WHERE k AND ret IS NOT NULL GROUP BY ALL""")
def event_signal_study(spark, sf):
    from ..operators.expanding import expanding_quantiles
    from ..operators.labels import event_returns

    m = FE.market_return(P.with_returns(spark, sf)).select(F.lit("M").alias("symbol"), "session", "pos", F.round(F.abs("mkt"), 9).alias("x"))
    q = expanding_quantiles(m, "x", {"hi": 0.9}, 252)
    sig = F.when(F.col("x") > F.col("hi"), "SHOCK").when(F.col("x") <= F.col("hi"), "CALM")
    s = q.select("pos", sig.alias("signal")).where("signal is not null")
    e = P.grid(spark, sf).where("asset_type = 'etf'").withColumn("flag", F.lit(True))
    legs = F.array(*[F.struct(F.lit(h).alias("horizon"), (shifted("px", -h) / shifted("open_adj", -1) - 1).alias("ret")) for h in (1, 3, 5, 10)])
    x = e.select("symbol", "pos", legs.alias("l")).select("symbol", "pos", F.inline("l")).where("ret is not null")
    return x.join(s, "pos").groupBy("signal", "symbol", "horizon").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


part("lev", "rev5 rets cal rates", """
WITH mem AS (SELECT session AS cohort, symbol, pos, CASE WHEN a <= 5 THEN 'TOP' WHEN b <= 5 THEN 'BOTTOM' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS a, row_number() OVER (PARTITION BY session ORDER BY rev, symbol) AS b,
  count(*) OVER (PARTITION BY session) AS n FROM rev5 WHERE rev IS NOT NULL AND session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))) WHERE n >= 10 AND (a <= 5 OR b <= 5) AND pos + 21 <= (SELECT max(pos) FROM cal)),
 d AS (SELECT m.cohort, r.pos - m.pos AS k, r.pos, avg(r.ret) FILTER (side = 'TOP') AS top, avg(r.ret) FILTER (side = 'BOTTOM') AS bot FROM mem m JOIN rets r ON r.symbol = m.symbol AND r.pos > m.pos AND r.pos <= m.pos + 21 GROUP BY ALL HAVING count(r.ret) > 0),
 fin AS (SELECT c.pos, (r.rate + 0.03)/360 AS f FROM cal c ASOF LEFT JOIN rates r ON c.session >= r.d + 1)
SELECT cohort, k, form, leverage, leverage*coalesce(CASE form WHEN 'LONG_ONLY' THEN top WHEN 'SHORT_ONLY' THEN -bot ELSE (top-bot)/2 END,0) - greatest(leverage-1,0)*coalesce(f,0) - CASE WHEN k IN (1,21) THEN 5/10000.0*leverage ELSE 0 END AS r
FROM d JOIN fin USING (pos) CROSS JOIN (VALUES ('LONG_ONLY'),('SHORT_ONLY'),('LONG_SHORT')) a(form) CROSS JOIN (VALUES (1.0),(1.5),(2.0)) b(leverage)""")


@query("PRT-18 TOP-05", "cohort form ~leverage ~outcome bankrupt", digits=5, parts="lev", sql="""
SELECT cohort, form, leverage, product(1+r)-1 AS outcome, bool_or(eq <= 0) AS bankrupt FROM (SELECT *, product(1+r) OVER (PARTITION BY cohort, form, leverage ORDER BY k) AS eq FROM lev) GROUP BY ALL""")
def levered_cohorts(spark, sf):
    from .joins import FINANCING, reference_rate_at_close

    mem = CO.cohort_members(X.month_end_rows(rev5(spark, sf), P.calendar(spark, sf)), "rev", 5, 10)
    fin = reference_rate_at_close(spark, sf).where(F.col("series") == FINANCING).join(P.calendar(spark, sf), "session").select("pos", "financing")
    last = P.calendar(spark, sf).count()
    return CO.cohort_outcomes(CO.form_paths(CO.cohort_paths(mem, P.with_returns(spark, sf), 21), fin, last, 21))


@query("PRT-19", "session ~increment", digits=5, parts="streams mkt", sql="""
WITH g AS (SELECT pos, coalesce(lag(lvl > avg20) OVER (ORDER BY pos), false) AS on_, lag(avg20) OVER (ORDER BY pos) AS a FROM (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(lvl) OVER w END AS avg20 FROM (SELECT pos, round(sum(coalesce(mkt,0)) OVER (ORDER BY pos), 9) AS lvl FROM mkt) WINDOW w AS (ORDER BY pos ROWS 19 PRECEDING))),
 c AS (SELECT session, pos, avg(net) AS v FROM streams GROUP BY ALL)
SELECT session, CASE WHEN on_ THEN v ELSE 0.0 END - v - 0.0003*abs(CAST(on_ AS DOUBLE) - coalesce(lag(CAST(on_ AS DOUBLE)) OVER (ORDER BY c.pos),0)) AS increment FROM c JOIN g ON g.pos = c.pos WHERE a IS NOT NULL""")
def overlay_increment(spark, sf):
    c = streams(spark, sf).groupBy("session", "pos").agg(F.avg("net").alias("v"))
    x = c.join(market_regime(spark, sf), "pos").withColumn("k", F.lit("C")).withColumn("p", F.col("on").cast("double"))
    f = PO.flip_stream(x, "p", "v", 0.0003, ("k",))
    return f.join(c.select("pos", "v"), "pos").withColumn("increment", F.col("net") - F.col("v"))


@query("PRT-21", "universe #n ~mean ~sharpe", digits=5, parts="rev5 rets members", sql="""
WITH u AS (SELECT symbol, session, pos, rev, 'ALL' AS universe FROM rev5 WHERE rev IS NOT NULL UNION ALL SELECT v.symbol, v.session, v.pos, v.rev, 'MEMBERS' FROM rev5 v WHERE rev IS NOT NULL AND EXISTS (SELECT 1 FROM members m WHERE m.symbol = v.symbol AND v.session >= m.start AND (m."end" IS NULL OR v.session < m."end"))),
 p AS (SELECT *, (rank() OVER (PARTITION BY universe, session ORDER BY rev) + (count(*) OVER (PARTITION BY universe, session, rev)-1)/2.0)/count(*) OVER (PARTITION BY universe, session) AS pct, count(*) OVER (PARTITION BY universe, session) AS n FROM u),
 w AS (SELECT *, CASE WHEN n >= 2 AND pct > 0.9 THEN 1.0 ELSE 0.0 END AS l, CASE WHEN n >= 2 AND pct <= 0.1 THEN 1.0 ELSE 0.0 END AS s FROM p),
 x AS (SELECT *, coalesce(l/nullif(sum(l) OVER g,0),0)-coalesce(s/nullif(sum(s) OVER g,0),0) AS weight FROM w WINDOW g AS (PARTITION BY universe, session)),
 b AS (SELECT universe, r.pos, CASE WHEN count(r.ret) > 0 THEN sum(coalesce(weight*r.ret,0)) END AS gross FROM x JOIN rets r ON r.symbol = x.symbol AND r.pos = x.pos + 2 WHERE weight <> 0 GROUP BY ALL)
SELECT universe, count(gross) AS n, avg(gross) AS mean, avg(gross)/stddev_samp(gross)*sqrt(252.0) AS sharpe FROM b GROUP BY universe""")
def universe_bias_delta(spark, sf):
    every = rev5(spark, sf).where("rev is not null").select("symbol", "session", "pos", "rev")
    x = every.withColumn("universe", F.lit("ALL")).unionByName(M.during(every, P.memberships(spark, sf), how="left_semi").withColumn("universe", F.lit("MEMBERS")))
    w = X.decile_weights(x, "rev", by=("universe", "session"))
    return I.summarize(PO.lagged_book(w, P.grid(spark, sf), 2, "universe"), ["universe"], "gross")


@query("PRT-23", "symbol session ~open ~high ~low ~close ~ret", parts="rets", sql="""
SELECT symbol, session, open_adj AS open, high_adj AS high, low_adj AS low, px AS close, CASE WHEN session > DATE '1996-01-01' THEN ret END AS ret FROM rets WHERE px IS NOT NULL AND session >= DATE '1996-01-01' AND session < DATE '2001-01-01'""")
def prepared_research_panel(spark, sf):
    from ..operators.filters import reasons  # noqa: F401
    from ..operators.prepare import research_panel

    return research_panel(P.with_returns(spark, sf), "1996-01-01", "2001-01-01")


@query("PRT-24", "session ~score ~win", digits=4, parts="rets flags", sql="""
WITH c AS (SELECT 'W' || (isodow(session)-1) AS cond, round(avg(ret),9) AS m, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END),9) AS h FROM rets WHERE ret IS NOT NULL GROUP BY 1 UNION ALL SELECT 'M' || month(session), round(avg(ret),9), round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END),9) FROM rets WHERE ret IS NOT NULL GROUP BY 1),
 up AS (SELECT CAST(unnest(generate_series((SELECT max(session) FROM rets) + INTERVAL 1 DAY, (SELECT max(session) FROM rets) + INTERVAL 63 DAY, INTERVAL 1 DAY)) AS DATE) AS session)
SELECT session, sum(m)*10000 AS score, avg(h) AS win FROM (SELECT session, unnest(['W' || (isodow(session)-1), 'M' || month(session)]) AS cond FROM up WHERE isodow(session) <= 5) JOIN c USING (cond) GROUP BY session""")
def alignment_scan(spark, sf):
    from ..operators.alerts import upcoming_days
    from ..operators.conditions import alignment

    return alignment(P.with_returns(spark, sf), upcoming_days(P.calendar(spark, sf), 63))


@query("STAT-14", "symbol session ~ret", parts="rets cal", sql="""
WITH p AS (SELECT a.pos, b.pos AS f FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM cal) a JOIN (SELECT pos, row_number() OVER (ORDER BY md5('7:' || strftime(session,'%Y-%m-%d')), pos) AS k FROM cal) b USING (k))
SELECT r.symbol, c.session, r.ret FROM rets r JOIN p ON p.f = r.pos JOIN cal c ON c.pos = p.pos WHERE r.ret IS NOT NULL""")
def shuffled_date_placebo(spark, sf):
    p = PL.shuffled_dates(P.calendar(spark, sf), 7)
    r = P.with_returns(spark, sf).where("ret is not null").select("symbol", F.col("pos").alias("from_pos"), "ret")
    return r.join(p, "from_pos").join(P.calendar(spark, sf), "pos")


@query("STAT-15", "symbol session ~weight", parts="deciles syms", sql="""
WITH p AS (SELECT a.symbol, b.symbol AS f FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM syms) a JOIN (SELECT symbol, row_number() OVER (ORDER BY md5('11:' || symbol), symbol) AS k FROM syms) b USING (k))
SELECT p.symbol, d.session, d.weight FROM deciles d JOIN p ON p.f = d.symbol WHERE d.weight <> 0""")
def permuted_label_placebo(spark, sf):
    return permuted(spark, sf)


def permuted(spark, sf):
    p = PL.permuted_labels(P.bars(spark, sf).select("symbol").distinct(), 11)
    return deciles(spark, sf).where("weight <> 0").select(F.col("symbol").alias("from_symbol"), "session", "pos", "weight").join(p, "from_symbol")


@query("STAT-15", "trial session ~net", parts="streams cal", sql="""
SELECT s.trial, c.session, s.net FROM streams s JOIN cal c ON c.pos = (s.pos - 1 + 137) % (SELECT count(*) FROM cal) + 1""")
def rotated_streams(spark, sf):
    p = PL.rotated(P.calendar(spark, sf), 137)
    return streams(spark, sf).select("trial", F.col("pos").alias("from_pos"), "net").join(p, "from_pos").join(P.calendar(spark, sf), "pos")


@query("STAT-16 AGG-15", "kind #n ~mean ~t_survivor", digits=5, parts="deciles rets cal syms", sql="""
WITH d AS (SELECT a.pos, b.pos AS f FROM (SELECT pos, row_number() OVER (ORDER BY pos) AS k FROM cal) a JOIN (SELECT pos, row_number() OVER (ORDER BY md5('7:' || strftime(session,'%Y-%m-%d')), pos) AS k FROM cal) b USING (k)),
 l AS (SELECT a.symbol, b.symbol AS f FROM (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM syms) a JOIN (SELECT symbol, row_number() OVER (ORDER BY md5('11:' || symbol), symbol) AS k FROM syms) b USING (k)),
 w AS (SELECT symbol, pos, weight FROM deciles WHERE weight <> 0),
 g AS (SELECT 'REAL' AS kind, w.pos, sum(coalesce(weight*ret,0)) AS g, count(ret) AS c FROM w JOIN rets r ON r.symbol = w.symbol AND r.pos = w.pos+2 GROUP BY ALL
 UNION ALL SELECT 'SHUFFLED_DATES', w.pos, sum(coalesce(weight*ret,0)), count(ret) FROM w JOIN d ON d.pos = w.pos + 2 JOIN rets r ON r.symbol = w.symbol AND r.pos = d.f GROUP BY ALL
 UNION ALL SELECT 'MATCHED_RANDOM', w.pos, sum(coalesce(weight*ret,0)), count(ret) FROM w JOIN l ON l.f = w.symbol JOIN rets r ON r.symbol = l.symbol AND r.pos = w.pos+2 GROUP BY ALL)
SELECT kind, count(*) AS n, avg(g) AS mean, CASE WHEN abs(avg(g)/stddev_samp(g)*sqrt(count(*))) > 3 THEN 1.0 ELSE 0.0 END AS t_survivor FROM g WHERE c > 0 GROUP BY kind""")
def placebo_trials(spark, sf):
    w, g, cal = deciles(spark, sf).where("weight <> 0").select("symbol", "pos", "weight"), P.grid(spark, sf), P.calendar(spark, sf)
    d = PL.shuffled_dates(cal, 7)
    shuffled = g.select("symbol", F.col("pos").alias("from_pos"), "ret").join(d, "from_pos").join(cal, "pos")
    books = {"REAL": PO.lagged_book(w, g, 2), "SHUFFLED_DATES": PO.lagged_book(w, shuffled, 2), "MATCHED_RANDOM": PO.lagged_book(permuted(spark, sf), g, 2)}
    out = None
    for kind, b in books.items():
        b = b.withColumn("kind", F.lit(kind))
        out = b if out is None else out.unionByName(b)
    s = I.summarize(out, ["kind"], "gross")
    t = F.abs(F.col("mean") / F.col("sd") * F.sqrt("n"))
    return s.withColumn("t_survivor", (t > 3).cast("double"))


# Controls of every trial: the same positions on exchanged dates, or exchanged symbols on the same dates.
part("control_seeds", "streams", """
SELECT trial, kind, trial || '|' || kind AS spec, CAST(CAST('0x' || substring(h,15,2) || substring(h,13,2) || substring(h,11,2) || substring(h,9,2) || substring(h,7,2) || substring(h,5,2) || substring(h,3,2) || substring(h,1,2) AS UBIGINT) AS VARCHAR) AS seed
FROM (SELECT *, sha256('0:' || trial || ':' || kind) AS h FROM (SELECT DISTINCT trial FROM streams) CROSS JOIN (VALUES ('SHUFFLED_DATES'),('MATCHED_RANDOM')) k(kind))""")
part("control_streams", "control_seeds cube streams rets cal syms", """
WITH d AS (SELECT spec, trial, row_number() OVER (PARTITION BY spec ORDER BY md5(seed || ':' || strftime(session,'%Y-%m-%d')), pos) AS pos, pos AS from_pos FROM control_seeds CROSS JOIN cal WHERE kind = 'SHUFFLED_DATES'),
 l AS (SELECT a.spec, a.trial, a.symbol AS from_symbol, b.symbol FROM (SELECT spec, trial, symbol, row_number() OVER (PARTITION BY spec ORDER BY md5(seed || ':' || symbol), symbol) AS k FROM control_seeds CROSS JOIN syms WHERE kind = 'MATCHED_RANDOM') a
  JOIN (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM syms) b USING (k)),
 x AS (SELECT d.spec, d.trial, 'SHUFFLED_DATES' AS kind, c.pos, c.session, c.weight, c.previous, r.ret, c.asset_type, c.adv FROM cube c JOIN d ON d.trial = c.trial AND d.pos = c.pos JOIN rets r ON r.symbol = c.symbol AND r.pos = d.from_pos
  UNION ALL SELECT l.spec, l.trial, 'MATCHED_RANDOM', c.pos, c.session, c.weight, c.previous, o.ret, o.asset_type, o.adv FROM cube c JOIN l ON l.trial = c.trial AND l.from_symbol = c.symbol JOIN cube o ON o.trial = c.trial AND o.symbol = l.symbol AND o.pos = c.pos)
SELECT trial AS spec, trial AS parent, 'REAL' AS kind, pos, session, net FROM streams UNION ALL
SELECT spec, trial, kind, pos, session, sum(coalesce(weight*ret,0)) - sum((abs(weight-previous)*(CASE WHEN asset_type='etf' THEN 1.0 ELSE 3.0 END/2 + least(1.0+10.0*sqrt(abs(weight-previous)*100000.0/adv),50.0) + 1.0) + greatest(-weight,0)*0.003/365.0*10000.0)/10000.0) FROM x GROUP BY ALL""")


def control_streams(spark, sf):
    from ..operators import controls as C

    def build():
        pos = S.positions(S.reversal_entries(signals(spark, sf)), 5, 2)
        return C.control_streams(pos, market(spark, sf), P.calendar(spark, sf)).withColumnRenamed("trial", "spec")

    return P.kept(spark, sf, "control-streams", build)


def control_tests(spark, sf):
    return P.kept(spark, sf, "control-tests", lambda: I.hac(control_streams(spark, sf), ["spec", "parent", "kind"], "pos", "net", 5))


CONTROL_TESTS = "WITH " + hac_sql("SELECT spec, parent, kind, pos, net AS v FROM control_streams", "spec, parent, kind", 5)


@query("STAT-16 STAT-26", "spec parent kind #n ~mean ~t", digits=5, parts="control_streams", sql=CONTROL_TESTS + " SELECT spec, parent, kind, n, mean, t FROM hac")
def trials_and_controls(spark, sf):
    """Every trial and its two declared controls under the same test."""
    return control_tests(spark, sf)


@query("AGG-15 STAT-16", "family kind #n_trials #n_survivors ~fraction", parts="control_streams", sql=CONTROL_TESTS + """
SELECT split_part(parent,'|',1) AS family, kind, count(*) AS n_trials, count(*) FILTER (n >= 100 AND mean > 0 AND t > 3) AS n_survivors, avg(CASE WHEN n >= 100 AND mean > 0 AND t > 3 THEN 1.0 ELSE 0.0 END) AS fraction FROM hac GROUP BY ALL""")
def family_survival(spark, sf):
    """Survivors of the gates of sample, sign and t for each signal, and the same fraction of its controls."""
    from ..operators import controls as C

    rule = (F.col("n") >= 100) & (F.col("mean") > 0) & (F.col("t") > 3)
    return C.survival(control_tests(spark, sf).withColumn("family", F.split("parent", "\\|")[0]), ["family"], rule)


@query("STAT-26 PRT-08", "spec kind ~mean ~t ~p ~p_bh ~dsr survivor", digits=5)
def discovery_with_controls(spark, sf):
    """The declared gates over the whole family of real trials and controls."""
    x = control_streams(spark, sf)
    tests = I.with_p(control_tests(spark, sf)).join(I.summarize(x, ["spec"], "net").drop("n", "mean"), "spec")
    return I.gauntlet(I.deflated(tests))
