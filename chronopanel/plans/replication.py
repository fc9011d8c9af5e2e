"""Known effects on the panel, and drift after announcements."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import monthly as MO
from ..operators import replication as R
from ..operators.crosssec import top_fraction
from ..operators.events import attach_availability, unexpected_earnings
from ..sources import panel as P
from .catalog import query
from .families import cross_streams
from .inference import market, streams
from .joins import eps
from .oracle_parts import part

# The panel's own years; the declared ones are parameters of the checks.
EVENTS, CRASH, EARLY, LATE = ("1994-01-01", "1999-12-31"), ("1998-01-01", "1998-12-31"), "1996-01-01", "1997-01-01"

part("known_effects", "mkt flags event_days rets streams cross_streams", f"""
WITH x AS (SELECT 'tom' AS g, m.pos, mkt AS v, turn_of_month AS f FROM mkt m JOIN flags USING (pos) WHERE mkt IS NOT NULL
  UNION ALL SELECT CASE WHEN session < DATE '{EARLY}' THEN 'early' ELSE 'late' END, pos, mkt, isodow(session) = 1 FROM mkt WHERE mkt IS NOT NULL AND (session < DATE '{EARLY}' OR session >= DATE '{LATE}')),
 s AS (SELECT g, avg(v) FILTER (f) AS em, avg(v) FILTER (NOT f) AS rm, avg(CAST(f AS DOUBLE)) AS sh, count(*) FILTER (f) AS ne, count(*) AS n FROM x GROUP BY g),
 i AS (SELECT x.g, row_number() OVER (PARTITION BY x.g ORDER BY pos) AS k, n, CASE WHEN f THEN (v-em)/sh ELSE -(v-rm)/(1-sh) END AS c FROM x JOIN s USING (g)),
 h AS (SELECT a.g, l.k, sum(a.c*b.c) AS h FROM i a JOIN (SELECT unnest(generate_series(0,12)) AS k) l ON l.k <= floor(4*power(a.n/100.0,2.0/9.0)) JOIN i b ON b.g = a.g AND b.k = a.k - l.k GROUP BY a.g, l.k),
 d AS (SELECT s.g, any_value(ne) AS ne, any_value(em) AS em, any_value(rm) AS rm, any_value(em-rm) AS d, any_value(em-rm)/(sqrt(sum(CASE WHEN k = 0 THEN h ELSE 2*(1-k/(floor(4*power(n/100.0,2.0/9.0))+1))*h END))/any_value(n)) AS t FROM s JOIN h ON h.g = s.g GROUP BY s.g),
 e AS (SELECT session, mkt FROM mkt WHERE mkt IS NOT NULL AND session IN (SELECT event_day FROM event_days)),
 p AS (SELECT count(*) AS n, avg(mkt) AS m, avg(mkt)/sqrt(var_pop(mkt)/count(*)) AS t FROM e WHERE session BETWEEN DATE '{EVENTS[0]}' AND DATE '{EVENTS[1]}'),
 o AS (SELECT symbol, sum(ln(open_adj/px1)) AS o, sum(ln(px/open_adj)) AS i FROM rets WHERE px1 IS NOT NULL AND px IS NOT NULL AND asset_type = 'etf' GROUP BY symbol),
 ms AS (SELECT session, gross, CASE WHEN count(gross) OVER w = 63 THEN product(1+gross) OVER w - 1 END AS c FROM cross_streams WHERE trial = 'momentum_12_1|ANY|LONG' WINDOW w AS (ORDER BY pos ROWS 62 PRECEDING))
SELECT 'turn_of_month' AS "check", d > 0 AND t > 2 AS passed, t AS statistic, em AS first, rm AS second, ne AS n FROM d WHERE g = 'tom'
UNION ALL SELECT 'pre_event', m > 0 AND t > 2, t, m, (SELECT avg(mkt) FROM e WHERE session > DATE '{EVENTS[1]}'), n FROM p
UNION ALL SELECT 'overnight_dominance', bool_and(o > i AND coalesce(CASE WHEN o+i > 0 THEN o/(o+i) END >= 0.75, false)), min(o-i), min(CASE WHEN o+i > 0 THEN o/(o+i) END), NULL, count(*) FROM o
UNION ALL SELECT 'momentum', avg(gross) > 0 AND min(c) FILTER (session BETWEEN DATE '{CRASH[0]}' AND DATE '{CRASH[1]}') <= -0.2, avg(gross), min(c) FILTER (session BETWEEN DATE '{CRASH[0]}' AND DATE '{CRASH[1]}'), NULL, count(gross) FROM ms
UNION ALL SELECT 'short_term_reversal', avg(gross) > 0 AND (avg(net) <= 0 OR avg(net) <= 0.5*avg(gross)), avg(net), avg(gross), avg(net)/avg(gross), count(net) FROM streams WHERE trial = 'raw|5|LONG'
UNION ALL SELECT 'monday_effect', max(d) FILTER (g = 'early') < 0 AND max(t) FILTER (g = 'early') < -2 AND abs(max(t) FILTER (g = 'late')) < 1.96 AND abs(max(d) FILTER (g = 'late')) < 0.0005, max(t) FILTER (g = 'late'), max(d) FILTER (g = 'early'), max(d) FILTER (g = 'late'), max(ne) FILTER (g = 'late') FROM d WHERE g <> 'tom'""")


@query("VAL-13", "check passed ~statistic ~first ~second #n promote", digits=5, parts="known_effects", sql="""
SELECT "check", coalesce(passed, false) AS passed, statistic, first, second, n, bool_and(coalesce(passed, false)) OVER () AS promote FROM known_effects""")
def replication_suite(spark, sf):
    """All six known effects on the panel; research is promoted only if each has passed."""
    r = P.with_returns(spark, sf)
    m = FE.market_return(r)
    momentum = cross_streams(spark, sf).where("trial = 'momentum_12_1|ANY|LONG'")
    return R.suite(
        R.turn_of_month(m, P.calendar_table(spark, sf)), R.event_day(m, P.event_days(spark, sf), *EVENTS), R.overnight_dominance(r.where("asset_type = 'etf'")),
        R.momentum_crash(momentum, *CRASH), R.reversal_cost_damage(streams(spark, sf).where("trial = 'raw|5|LONG'")), R.monday_decay(m, EARLY, LATE))


part("drift", "eps anns cal rets", """
WITH d AS (SELECT a.symbol, a.q, a.quarter_end, a.filed, a.value - b.value AS difference FROM eps a JOIN eps b ON a.symbol = b.symbol AND b.q = a.q - 4),
 u AS (SELECT symbol, q, quarter_end, filed, difference/sd AS sue FROM (SELECT *, count(*) OVER w AS n, stddev_samp(difference) OVER w AS sd FROM d WINDOW w AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)) WHERE n >= 6 AND sd > 1e-6),
 k AS (SELECT u.symbol, u.q, u.sue, least(u.filed, coalesce(min(a.event_day), u.filed)) AS available FROM u LEFT JOIN anns a ON a.symbol = u.symbol AND a.kind = 'EARNINGS' AND a.event_day > u.quarter_end AND a.event_day <= u.quarter_end + 90 GROUP BY u.symbol, u.q, u.sue, u.filed),
 p AS (SELECT symbol, q, sue, (SELECT min(pos) FROM cal WHERE session > available) AS first FROM k),
 m AS (SELECT session, pos, row_number() OVER (ORDER BY session) AS k, lead(pos) OVER (ORDER BY session) AS next_pos FROM cal WHERE session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))),
 t AS (SELECT * FROM (VALUES ('sue_top_decile_63d', 63, 10), ('sue_top_quintile_63d', 63, 5), ('sue_top_quintile_21d', 21, 5)) t(study, stale, denominator)),
 f AS (SELECT t.study, t.denominator, m.k, m.pos, m.next_pos, p.symbol, arg_max(p.sue, p.first*100000 + p.q) AS sue FROM t JOIN p ON true JOIN m ON m.pos BETWEEN p.first AND p.first + t.stale - 1 JOIN rets r ON r.symbol = p.symbol AND r.pos = m.pos AND r.ret IS NOT NULL AND r.asset_type = 'equity' GROUP BY ALL),
 sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, k ORDER BY sue DESC, symbol) AS r, floor(count(*) OVER (PARTITION BY study, k)/denominator) AS names FROM f) WHERE r <= names AND names >= 1)
SELECT study, session, sum(w*r)/sum(w) AS gross FROM (SELECT *, coalesce(product(1+r) OVER (PARTITION BY study, k, symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS w FROM (
 SELECT s.study, s.k, s.symbol, t.pos, t.session, coalesce(t.ret,0) AS r FROM sel s JOIN rets t ON t.symbol = s.symbol AND t.pos > s.pos AND t.pos <= s.next_pos)) GROUP BY study, session""")


# Study, sessions that a surprise stays fresh, one name of how many is held.
STUDIES = (("sue_top_decile_63d", 63, 10), ("sue_top_quintile_63d", 63, 5), ("sue_top_quintile_21d", 21, 5))


@query("PRT-09 JOIN-05", "study session ~gross", parts="drift", sql="SELECT * FROM drift")
def announcement_drift(spark, sf):
    """Monthly books of the largest earnings surprises that were known and fresh, gross."""
    return drift_streams(spark, sf).where("gross is not null")


@query("PRT-09", "study #months ~gross ~cost ~net ~share_active", digits=5)
def announcement_drift_costs(spark, sf):
    """The same books after per-name change costs."""
    x = drift_streams(spark, sf)
    days = P.calendar(spark, sf).agg(F.count("*").alias("days"))
    s = x.groupBy("study").agg(F.count_distinct(F.trunc("session", "MM")).alias("months"), *[F.sum(c).alias(c) for c in ("gross", "cost", "net")], F.count("gross").alias("active"))
    return s.crossJoin(days).withColumn("share_active", F.col("active") / F.col("days"))  # one row of days


def drift_streams(spark, sf):
    def build():
        m, cal = market(spark, sf), P.calendar(spark, sf)
        sue = unexpected_earnings(eps(spark, sf)).where("sd > 1e-6").select("symbol", "q", "sue").join(eps(spark, sf), ["symbol", "q"])
        seen = attach_availability(sue, P.announcements(spark, sf).where("kind = 'EARNINGS'")).select("symbol", "quarter_end", "available")
        known = sue.join(seen, ["symbol", "quarter_end"]).select("symbol", "q", "sue", "available")
        ends = MO.numbered_month_ends(cal)
        usable, held = MO.first_usable(known, "available", cal), m.where("ret is not null and asset_type = 'equity'").select("symbol", "session")
        stale = {n for _, n, _ in STUDIES}
        fresh = {n: MO.fresh_at(usable, ends, "sue", "q", n).join(held, ["symbol", "session"]) for n in stale}
        rows = reduce(DataFrame.unionByName, [fresh[n].select(F.lit(name).alias("study"), F.lit(d).alias("denominator"), "symbol", "session", "sue") for name, n, d in STUDIES])
        return MO.study(top_fraction(rows, "sue", F.col("denominator"), 1, False, by=("study", "session")), ends, m, cal, by=("study",))

    return P.kept(spark, sf, "drift", build)
