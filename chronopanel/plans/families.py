"""The declared families: cross-sectional trials as streams, and every declared trial against the data that backs it."""

from pyspark.sql import functions as F

from ..operators import crossfamilies as CF
from ..operators import families as FA
from ..operators import streams as S
from ..operators.trials import calendar_predicates, predicate_sessions, predicate_table
from ..sources import panel as P
from .catalog import query
from .inference import market, streams
from .joins import eps
from .oracle_parts import part

part("scored", "rets", """
SELECT symbol, pos, u.family, u.score FROM (SELECT symbol, pos, unnest([
 {'family': 'momentum_12_1', 'score': lag(px,21) OVER w / lag(px,252) OVER w - 1}, {'family': 'reversal_5d', 'score': -(px/lag(px,5) OVER w - 1)},
 {'family': 'low_volatility', 'score': CASE WHEN count(lr) OVER y = 252 THEN -(stddev_samp(lr) OVER y * sqrt(252.0)) END}, {'family': 'high_52w_proximity', 'score': CASE WHEN count(px) OVER y = 252 THEN px/max(px) OVER y END},
 {'family': 'amihud_illiquidity', 'score': CASE WHEN count(dv) OVER m = 21 THEN avg(dv) OVER m END}, {'family': 'max_lottery', 'score': CASE WHEN count(ret) OVER m = 21 THEN max(ret) OVER m END},
 {'family': 'overnight_intraday_gap', 'score': CASE WHEN count(gap) OVER m = 21 THEN avg(gap) OVER m END}, {'family': 'etf_relative_reversal', 'score': CASE WHEN asset_type = 'etf' THEN -(px/lag(px,21) OVER w - 1) END}]) AS u, px
FROM (SELECT *, ln(px/px1) AS lr, abs(ret)/nullif(px*volume,0) AS dv, (open_adj/px1-1)-(px/open_adj-1) AS gap FROM rets)
WINDOW w AS (PARTITION BY symbol ORDER BY pos), y AS (PARTITION BY symbol ORDER BY pos ROWS 251 PRECEDING), m AS (PARTITION BY symbol ORDER BY pos ROWS 20 PRECEDING)) WHERE px IS NOT NULL AND u.score IS NOT NULL""")
part("ranked", "scored", """
SELECT family, symbol, pos, coalesce(l/nullif(sum(l) OVER s,0),0) - coalesce(h/nullif(sum(h) OVER s,0),0) AS weight FROM (SELECT *, CASE WHEN pct > 0.9 THEN 1.0 ELSE 0.0 END AS l, CASE WHEN pct <= 0.1 THEN 1.0 ELSE 0.0 END AS h FROM (
SELECT *, CASE WHEN count(*) OVER (PARTITION BY family, pos) >= 2 THEN (rank() OVER (PARTITION BY family, pos ORDER BY score) + (count(*) OVER (PARTITION BY family, pos, score)-1)/2.0) / count(*) OVER (PARTITION BY family, pos) END AS pct FROM scored)) WINDOW s AS (PARTITION BY family, pos)""")
part("gate_days", "flags", """
SELECT 'weekday=4' AS gate, pos FROM flags WHERE weekday = 4 UNION ALL SELECT 'turn_of_month=TOM', pos FROM flags WHERE turn_of_month UNION ALL SELECT 'month_end=WINDOW', pos FROM flags WHERE month_end_window UNION ALL SELECT 'quarter_end=WINDOW', pos FROM flags WHERE quarter_end_window""")
part("cross_weights", "ranked gate_days cal", """
WITH f AS (SELECT min(pos) AS a, coalesce(lead(min(pos)) OVER (ORDER BY min(pos)), (SELECT max(pos) + 1 FROM cal)) AS b FROM cal GROUP BY date_trunc('month', session)),
 e AS (SELECT family, 'ANY' AS gate, symbol, pos, CASE WHEN family IN ('reversal_5d','overnight_intraday_gap','etf_relative_reversal') THEN 5 ELSE 21 END AS held, weight FROM ranked WHERE weight <> 0 AND family <> 'momentum_12_1'
  UNION ALL SELECT family, gate, symbol, r.pos, 5, weight FROM ranked r JOIN gate_days g ON g.pos = r.pos + 2 WHERE weight <> 0 AND family IN ('momentum_12_1','reversal_5d')),
 d AS (SELECT family, gate, symbol, pos + 2 + k AS pos, weight/held AS weight FROM e JOIN (SELECT unnest(generate_series(0,20)) AS k) ON k < held
  UNION ALL SELECT family, 'ANY', symbol, c.pos + 2, weight FROM ranked r JOIN f ON f.a = r.pos JOIN cal c ON c.pos >= a AND c.pos < b WHERE weight <> 0 AND family = 'momentum_12_1')
SELECT family || '|' || gate AS t, symbol, pos, sum(weight) AS weight FROM d GROUP BY ALL""")
part("cross_streams", "cross_weights rets", """
SELECT t || '|' || side AS trial, pos, session, sum(coalesce(w*ret,0)) AS gross, sum((abs(w-p)*(CASE WHEN asset_type='etf' THEN 1.0 ELSE 3.0 END/2 + least(1.0+10.0*sqrt(abs(w-p)*100000.0/adv),50.0) + 1.0) + greatest(-w,0)*0.003/365.0*10000.0)/10000.0) AS cost, sum(abs(w)) AS exposure FROM (
SELECT t, side, sign*weight AS w, sign*coalesce(lag(weight) OVER (PARTITION BY t, side, symbol ORDER BY pos), 0) AS p, pos, session, ret, asset_type, adv FROM (
 SELECT t.t, g.symbol, g.pos, g.session, g.ret, g.asset_type, g.adv, coalesce(x.weight, 0) AS weight FROM (SELECT DISTINCT t FROM cross_weights) t
 CROSS JOIN (SELECT *, CASE WHEN px IS NULL THEN 1e8 ELSE coalesce(avg(px*volume) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),1e8) END AS adv FROM rets) g
 LEFT JOIN cross_weights x ON x.t = t.t AND x.symbol = g.symbol AND x.pos = g.pos) CROSS JOIN (VALUES ('LONG', 1.0), ('SHORT', -1.0)) s(side, sign)) GROUP BY ALL""")


def cross_streams(spark, sf):
    def build():
        entries = CF.family_entries(CF.scores(P.with_returns(spark, sf)), P.calendar_table(spark, sf))
        return S.evaluate(CF.standing_positions(entries), market(spark, sf), P.calendar(spark, sf))

    return P.kept(spark, sf, "cross_streams", build)


@query("PRT-05 FUN-19 PRT-02", "trial session ~gross ~cost ~exposure ~net", digits=5, parts="cross_streams", sql="SELECT trial, session, gross, cost, exposure, gross - cost AS net FROM cross_streams")
def cross_sectional_trials(spark, sf):
    """Eight declared features and eight gated combinations, long and short, as daily streams with costs."""
    return cross_streams(spark, sf)


part("declared_backed", "streams cross_streams flags eps", """
WITH f AS (SELECT pos, 'weekday' AS family, CAST(weekday AS VARCHAR) AS value FROM flags UNION ALL SELECT pos, 'month', CAST(month AS VARCHAR) FROM flags UNION ALL SELECT pos, 'opex', 'WEEK' FROM flags WHERE opex_week
 UNION ALL SELECT pos, 'turn_of_month', CASE WHEN turn_of_month THEN 'TOM' ELSE 'REST' END FROM flags UNION ALL SELECT pos, 'holiday', 'PRE' FROM flags WHERE pre_holiday UNION ALL SELECT pos, 'holiday', 'POST' FROM flags WHERE post_holiday
 UNION ALL SELECT pos, 'event', 'DAY_BEFORE' FROM flags WHERE event_day_before UNION ALL SELECT pos, 'event', 'DAY_OF' FROM flags WHERE event_day_of UNION ALL SELECT pos, 'event', 'EVENT_WEEK' FROM flags WHERE event_week
 UNION ALL SELECT pos, 'month_end', CASE WHEN month_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags UNION ALL SELECT pos, 'quarter_end', CASE WHEN quarter_end_window THEN 'WINDOW' ELSE 'REST' END FROM flags),
 h AS (SELECT 'ANY' AS h, pos FROM flags UNION ALL SELECT family || '=' || value, pos FROM f UNION ALL SELECT a.family || '=' || a.value || '&' || b.family || '=' || b.value, a.pos FROM f a JOIN f b ON a.pos = b.pos AND a.family < b.family),
 q AS (SELECT count(*) AS n FROM (SELECT symbol, q, count(*) OVER w AS n, stddev_samp(d) OVER w AS sd FROM (SELECT a.symbol, a.q, a.value - b.value AS d FROM eps a JOIN eps b ON b.symbol = a.symbol AND b.q = a.q - 4) WINDOW w AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) WHERE n >= 6 AND sd > 1e-9)
SELECT 'CALENDAR' AS family, count(*)*12 AS n_backed, sum(n)*12 AS n_sessions FROM (SELECT h, count(DISTINCT pos) AS n FROM h GROUP BY h)
UNION ALL SELECT 'REVERSAL', count(DISTINCT trial), count(*) FROM streams WHERE exposure > 0
UNION ALL SELECT CASE WHEN trial LIKE '%|ANY|%' THEN 'CROSS_SECTIONAL' ELSE 'COMBINATION' END, count(DISTINCT trial), count(*) FROM cross_streams WHERE exposure > 1e-12 GROUP BY 1
UNION ALL SELECT 'PEAD', 1, n FROM q WHERE n > 0""")


@query("FUN-18 FUN-19", "family #n_trials #n_backed #n_sessions", parts="declared_backed", sql="""
SELECT family, n_trials, coalesce(n_backed, 0) AS n_backed, coalesce(n_sessions, 0) AS n_sessions FROM (VALUES ('CALENDAR', 4236), ('REVERSAL', 30), ('LOSS_AWARE', 900), ('OVERNIGHT', 24), ('CROSS_SECTIONAL', 16), ('COMBINATION', 16), ('VETO', 10), ('PEAD', 1)) t(family, n_trials)
LEFT JOIN declared_backed USING (family) WHERE family <> 'PEAD' OR n_backed > 0""")
def declared_families(spark, sf):
    """Declared trials of each family, how many of them the streams, calendar and estimates back, and with how many
    sessions (drift after announcements: estimates; without any it is not declared)."""
    from ..operators.events import unexpected_earnings

    flags = P.calendar_table(spark, sf)
    hits = predicate_sessions(predicate_table(spark), calendar_predicates(flags)).select("hypothesis", "pos").unionByName(flags.select(F.lit("ANY").alias("hypothesis"), "pos"))
    days = hits.groupBy("hypothesis").agg(F.count_distinct("pos").alias("n"))
    grid = FA.calendar_specs(spark).join(days, F.element_at(F.split("spec", "\\|"), 1) == F.col("hypothesis")).select("family", "spec", "n")
    held = lambda s, family: s.where("exposure > 1e-12").groupBy(F.col("trial").alias("spec")).agg(F.count("*").alias("n")).select(family.alias("family"), "spec", "n")
    own = held(streams(spark, sf), F.lit("REVERSAL"))
    cross = held(cross_streams(spark, sf), F.when(F.col("spec").like("%|ANY|%"), "CROSS_SECTIONAL").otherwise("COMBINATION"))
    drift = unexpected_earnings(eps(spark, sf)).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("PEAD").alias("family"), F.lit("pead_sue|LONG").alias("spec"), "n")
    backed = grid.unionByName(own).unionByName(cross).unionByName(drift)
    declared = FA.declared(spark).unionByName(drift.select("family", "spec"))
    x = declared.join(backed, ["family", "spec"], "left")
    return x.groupBy("family").agg(F.count("*").alias("n_trials"), F.count("n").alias("n_backed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_sessions"))
