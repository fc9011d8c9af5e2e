"""Data-quality queries."""

from pyspark.sql import functions as F

from ..operators import membership as M
from ..operators import quality as Q
from ..operators import reconcile as R
from ..operators import recursive as REC
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part


@query("QA-01", "#n_rows #missing_key #availability #price #range #volume #duplicates", parts="bars", sql="""
SELECT count(*) AS n_rows, 0 AS missing_key, 0 AS availability, count(*) FILTER (least(open,high,low,close) <= 0) AS price,
 count(*) FILTER (high < greatest(open,close,low)-1e-12 OR low > least(open,close,high)+1e-12) AS "range", count(*) FILTER (volume < 0) AS volume,
 (SELECT count(*) FROM (SELECT 1 FROM bars GROUP BY symbol, session HAVING count(*) > 1)) AS duplicates FROM bars""")
def canonical_bar_gate(spark, sf):
    return Q.bar_gate(P.bars(spark, sf))


part("checks", "bars", """
SELECT *, CASE WHEN n >= 20 THEN (lr-mu)/nullif(sd,0) END AS z FROM (SELECT *, count(lr) OVER p AS n, avg(lr) OVER p AS mu, stddev_samp(lr) OVER p AS sd FROM (
SELECT *, ln(adjusted_close/lag(adjusted_close) OVER w) AS lr, close/lag(close) OVER w - 1 AS rr, adjusted_close/lag(adjusted_close) OVER w - 1 AS ar FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session))
WINDOW p AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
part("runs", "bars", """
SELECT symbol, min(session) AS first_session, max(session) AS last_session, count(*) AS length FROM (
SELECT symbol, session, sum(m) OVER (PARTITION BY symbol ORDER BY session) AS run FROM (SELECT symbol, session, CASE WHEN close = lag(close) OVER (PARTITION BY symbol ORDER BY session) THEN 0 ELSE 1 END AS m FROM bars)) GROUP BY symbol, run""")
part("gaps", "bars cal", """
SELECT l.symbol, c.session FROM (SELECT symbol, min(session) AS lo, max(session) AS hi FROM bars GROUP BY symbol) l JOIN cal c ON c.session BETWEEN l.lo AND l.hi
WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = l.symbol AND b.session = c.session)""")


@query("WIN-30 WIN-32", "symbol session ~z outlier jump", digits=5, parts="checks", sql="""
SELECT symbol, session, z, coalesce(abs(z) > 4, false) AS outlier, coalesce(abs(rr) > 0.25 AND NOT (split_factor <> 1 OR dividend <> 0 OR abs(abs(rr)-abs(ar)) > 0.1), false) AS jump FROM checks""")
def price_outliers_and_jumps(spark, sf):
    return Q.price_checks(P.bars(spark, sf), 4.0, jump=0.25)


@query("WIN-31", "symbol first_session last_session #length", parts="runs", sql="SELECT * FROM runs WHERE length >= 2")
def stale_price_runs(spark, sf):
    return Q.stale_runs(P.bars(spark, sf), minimum=2)


@query("JOIN-07 SET-02", "symbol session", parts="gaps", sql="SELECT * FROM gaps")
def missing_bars(spark, sf):
    return Q.missing_sessions(P.bars(spark, sf), P.calendar(spark, sf))


part("audits", "checks runs gaps", """
SELECT a.*, coalesce(g.missing,0) AS missing, coalesce(r.stale_runs,0) AS stale_runs FROM (
SELECT symbol, count(*) AS observed, count(*) FILTER (volume <= 0) AS zero_volume, count(*) FILTER (abs(z) > 4) AS outliers,
 count(*) FILTER (abs(rr) > 0.25 AND NOT (split_factor <> 1 OR dividend <> 0 OR abs(abs(rr)-abs(ar)) > 0.1)) AS jumps FROM checks GROUP BY symbol) a
LEFT JOIN (SELECT symbol, count(*) AS missing FROM gaps GROUP BY symbol) g USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS stale_runs FROM runs WHERE length >= 2 GROUP BY symbol) r USING (symbol)""")


def audit(spark, sf):
    return P.kept(spark, sf, "audit", lambda: Q.audit(P.bars(spark, sf), P.calendar(spark, sf), 4.0, 0.25, 2))


@query("QA-02", "symbol #expected #observed #missing ~missing_fraction #zero_volume #stale_runs #outliers #jumps", parts="audits", sql="""
SELECT symbol, observed+missing AS expected, observed, missing, missing/(observed+missing) AS missing_fraction, zero_volume, stale_runs, outliers, jumps FROM audits""")
def instrument_audit(spark, sf):
    return audit(spark, sf)


@query("QA-02 QA-03", "symbol code #n", parts="audits", sql="""
SELECT * FROM (SELECT symbol, 'MISSING_BAR' AS code, missing AS n FROM audits UNION ALL SELECT symbol, 'ZERO_VOLUME', zero_volume FROM audits UNION ALL SELECT symbol, 'STALE_PRICE', stale_runs FROM audits
UNION ALL SELECT symbol, 'CAUSAL_OUTLIER', outliers FROM audits UNION ALL SELECT symbol, 'UNEXPLAINED_JUMP', jumps FROM audits) WHERE n > 0""")
def audit_issues(spark, sf):
    return Q.issues(audit(spark, sf))


@query("QA-03", "#symbols ~missing_fraction passed", parts="audits", sql="SELECT count(*) AS symbols, sum(missing)/sum(observed+missing) AS missing_fraction, sum(missing)/sum(observed+missing) <= 0.01 AS passed FROM audits")
def panel_missing_gate(spark, sf):
    x = audit(spark, sf).agg(F.count("*").alias("symbols"), (F.sum("missing") / F.sum("expected")).alias("missing_fraction"))
    return x.withColumn("passed", F.col("missing_fraction") <= 0.01)


part("ownrows", "bars", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM bars")
part("wins", "ownrows", """
SELECT symbol, i, session, adjusted_close AS px, ln(adjusted_close) AS path, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS m2 FROM ownrows WHERE i = 1
UNION ALL
SELECT symbol, i, session, px, path0 + mv AS path, n+1, mu + (mv-mu)/(n+1), m2 + (mv-mu)*(mv - (mu + (mv-mu)/(n+1))) FROM (
SELECT o.symbol, o.i, o.session, o.adjusted_close AS px, w.path AS path0, w.n, w.mu, w.m2, CASE WHEN w.n >= 20 AND w.m2 > 0
  THEN least(greatest(ln(o.adjusted_close)-w.path, w.mu - 2.5*sqrt(w.m2/(w.n-1))), w.mu + 2.5*sqrt(w.m2/(w.n-1))) ELSE ln(o.adjusted_close)-w.path END AS mv
FROM wins w JOIN ownrows o ON o.symbol = w.symbol AND o.i = w.i + 1)""")


@query("QA-04", "symbol session ~fixed corrected", digits=5, parts="wins", sql="SELECT symbol, session, exp(path) AS fixed, abs(path - ln(px)) > 1e-9 AS corrected FROM wins")
def causal_winsorized_prices(spark, sf):
    return REC.causal_winsorize(P.placed(spark, sf), sigma=2.5)


part("pair", "bars bars_b", """
SELECT symbol, session, a.close AS ca, b.close AS cb, a.c1 AS ca1, b.c1 AS cb1, a.p AS pa, b.p AS pb, b.dividend AS d, b.split_factor AS s FROM
(SELECT *, lag(close) OVER w AS c1, lag(session) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session)) a JOIN
(SELECT *, lag(close) OVER w AS c1, lag(session) OVER w AS p FROM bars_b WINDOW w AS (PARTITION BY symbol ORDER BY session)) b USING (symbol, session)""")


def pair(spark, sf):
    return R.paired(P.bars(spark, sf), P.second_provider(spark, sf))


@query("JOIN-01 QA-05", "symbol #n_common ~within ~worst passed", parts="pair", sql="""
SELECT symbol, count(*) AS n_common, avg(CASE WHEN rel <= 0.05 THEN 1.0 ELSE 0.0 END) AS within, max(rel) AS worst, avg(CASE WHEN rel <= 0.05 THEN 1.0 ELSE 0.0 END) >= 0.5 AS passed FROM (
SELECT symbol, abs((ca/first_value(ca) OVER w)/(cb/first_value(cb) OVER w)-1) AS rel FROM pair WINDOW w AS (PARTITION BY symbol ORDER BY session)) GROUP BY symbol""")
def rebased_reconciliation(spark, sf):
    return R.rebased(pair(spark, sf), 0.05, 0.5)


@query("QA-06", "symbol #n_plain #n_action ~plain_within ~action_within", parts="pair", sql="""
SELECT symbol, count(*) FILTER (NOT act) AS n_plain, count(*) FILTER (act) AS n_action, avg(CASE WHEN abs(ca/ca1-cb/cb1) <= 0.02 THEN 1.0 ELSE 0.0 END) FILTER (NOT act) AS plain_within,
 avg(CASE WHEN abs((ca*s+d)/ca1-(cb*s+d)/cb1) <= 0.02 THEN 1.0 ELSE 0.0 END) FILTER (act) AS action_within FROM (SELECT *, d <> 0 OR s <> 1 AS act FROM pair WHERE pa IS NOT NULL AND pa = pb) GROUP BY symbol""")
def action_stratified_returns(spark, sf):
    return R.action_stratified(pair(spark, sf), 0.02)


@query("QA-07", "symbol #n #raw #split #total convention verdict", parts="pair", sql="""
SELECT *, CASE WHEN raw = best THEN 'RAW' WHEN split = best THEN 'SPLIT_ADJUSTED' ELSE 'TOTAL_RETURN' END AS convention,
 CASE WHEN n < 3 THEN 'UNCHECKABLE' WHEN best >= ceil(n*0.95) THEN 'CONFIRMED' WHEN best = 0 THEN 'DISAGREES' ELSE 'MIXED' END AS verdict FROM (
SELECT symbol, count(*) AS n, count(*) FILTER (abs(o/r-1) <= 0.02) AS raw, count(*) FILTER (abs(o/(r*s)-1) <= 0.02) AS split, count(*) FILTER (abs(o/((cb*s+d)/cb1)-1) <= 0.02) AS total,
 greatest(count(*) FILTER (abs(o/r-1) <= 0.02), count(*) FILTER (abs(o/(r*s)-1) <= 0.02), count(*) FILTER (abs(o/((cb*s+d)/cb1)-1) <= 0.02)) AS best
FROM (SELECT *, ca/ca1 AS o, cb/cb1 AS r FROM pair WHERE pa IS NOT NULL AND pa = pb AND (d <> 0 OR s <> 1)) GROUP BY symbol)""")
def action_convention_votes(spark, sf):
    return R.action_votes(pair(spark, sf), 0.02)


@query("QA-08 AGG-19", "symbol #observed ~coverage ~years first_session last_session long_enough", parts="bars cal", sql="""
SELECT symbol, count(DISTINCT session) AS observed, count(DISTINCT session)/(SELECT count(*) FROM cal) AS coverage, date_diff('day', min(session), max(session))/365.2425 AS years,
 min(session) AS first_session, max(session) AS last_session, date_diff('day', min(session), max(session))/365.2425 >= 6.5 AS long_enough FROM bars GROUP BY symbol""")
def coverage_and_span(spark, sf):
    return Q.coverage(P.bars(spark, sf), P.calendar(spark, sf)).withColumn("long_enough", F.col("years") >= 6.5)


part("changes", "members", """SELECT symbol, start AS effective, 'ADD' AS action FROM members UNION ALL SELECT symbol, "end", 'REMOVE' FROM members WHERE "end" IS NOT NULL""")


@query("QA-09 JOIN-13", "#year #removed #covered", parts="changes bars", sql="""
SELECT year(effective) AS year, count(*) AS removed, count(*) FILTER (EXISTS (SELECT 1 FROM bars b WHERE b.symbol = c.symbol AND b.session >= c.effective - 30 AND b.session < c.effective)) AS covered FROM changes c WHERE action = 'REMOVE' GROUP BY 1""")
def removed_member_coverage(spark, sf):
    """A removed member is covered if it has a bar in the thirty days before its removal."""
    removed = M.change_log(P.memberships(spark, sf)).where("action = 'REMOVE'")
    b = P.bars(spark, sf).select(F.col("symbol").alias("_s"), "session")
    near = (F.col("symbol") == F.col("_s")) & (F.col("session") >= F.date_sub("effective", 30)) & (F.col("session") < F.col("effective"))
    have = removed.join(b, near, "left_semi").select("symbol", "effective").distinct().withColumn("have", F.lit(True))
    return removed.join(have, ["symbol", "effective"], "left").groupBy(F.year("effective").alias("year")).agg(F.count("*").alias("removed"), F.count("have").alias("covered"))


@query("QA-10 QA-11", "symbol start end", parts="members", sql="""
SELECT symbol, greatest(start, DATE '1996-01-01') AS start, CASE WHEN "end" IS NOT NULL THEN least("end", DATE '2000-12-31') END AS "end" FROM members
WHERE start <= DATE '2000-12-31' AND ("end" IS NULL OR least("end", DATE '2000-12-31') > greatest(start, DATE '1996-01-01'))""")
def rebuilt_memberships(spark, sf):
    m = P.memberships(spark, sf)
    return M.replay(M.change_log(m), m.where("end is null"), "1996-01-01", "2000-12-31")


@query("QA-15 SRC-22", "symbol start fault", parts="anns", sql="""
WITH i AS (SELECT symbol, event_day AS start, max(coalesce(ended_day, event_day + 40)) AS "end" FROM anns WHERE kind IN ('HALT','EARNINGS') GROUP BY ALL)
SELECT symbol, start, CASE WHEN "end" <= start THEN 'INVERTED' WHEN start < p THEN 'OVERLAP' END AS fault FROM (SELECT *, lag("end") OVER (PARTITION BY symbol ORDER BY start) AS p FROM i) WHERE "end" <= start OR start < p""")
def interval_faults(spark, sf):
    a = P.announcements(spark, sf).where("kind in ('HALT', 'EARNINGS')")
    i = a.groupBy("symbol", F.col("event_day").alias("start")).agg(F.max(F.coalesce("ended_day", F.date_add("event_day", 40))).alias("end"))
    return M.interval_faults(i)


_WORDS = " || ".join(f"printf('%08x', CAST(sum(CAST('0x' || substring(h, {8 * k + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT))" for k in range(8))


@query("QA-12 QA-14", "symbol #n_rows digest", parts="bars", sql=f"""
SELECT symbol, count(*) AS n_rows, {_WORDS} AS digest FROM (
SELECT symbol, sha256(symbol || '|' || session || '|' || CAST(round(close * 100) AS BIGINT) || '|' || CAST(volume AS BIGINT)) AS h FROM bars) GROUP BY symbol""")
def table_digests(spark, sf):
    b = P.bars(spark, sf).select("symbol", "session", F.round(F.col("close") * 100).cast("bigint").alias("cents"), F.col("volume").cast("bigint").alias("volume"))
    return Q.table_digest(b, ["symbol"])


@query("QA-13", "#n_rows #bad", parts="anns", sql="SELECT count(*) AS n_rows, count(*) FILTER (event_day > DATE '2000-06-01') AS bad FROM anns")
def provenance_report(spark, sf):
    a = P.announcements(spark, sf).select(
        F.col("available_day").cast("timestamp").alias("available_at"), F.col("available_day").cast("timestamp").alias("fetched_at"),
        F.when(F.col("event_day") <= F.lit("2000-06-01").cast("date"), F.sha2(F.col("event_id").cast("string"), 256)).otherwise("none").alias("content_hash"))
    return a.agg(F.count("*").alias("n_rows"), F.count_if(Q.provenance_faults()).alias("bad"))


@query("QA-16", "column present #n_values")
def required_columns(spark, sf):
    """Which required columns a landed table has, and how many values each holds (0 where it is missing)."""
    from ..schemas import BARS

    b = P.bars(spark, sf)
    lost = Q.missing_columns(b, BARS.names)
    held = b.agg(*[(F.lit(0) if c in lost else F.count(c)).cast("bigint").alias(c) for c in BARS.names])
    return held.unpivot([], BARS.names, "column", "n_values").withColumn("present", ~F.col("column").isin(*lost) if lost else F.lit(True))


@query("AGG-26", "#intended #available ~missing_fraction bias", parts="anns bars", sql="""
SELECT count(a.symbol) AS intended, count(b.symbol) FILTER (a.symbol IS NOT NULL) AS available, (count(a.symbol)-count(b.symbol) FILTER (a.symbol IS NOT NULL))/count(a.symbol) AS missing_fraction, 'SURVIVORSHIP_BIASED' AS bias
FROM (SELECT DISTINCT symbol FROM anns) a FULL JOIN (SELECT DISTINCT symbol FROM bars) b ON a.symbol = b.symbol""")
def survivorship_audit(spark, sf):
    return Q.survivorship(P.announcements(spark, sf), P.bars(spark, sf), False)


@query("SET-05", "symbol session", sql="""
SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS session FROM lineitem GROUP BY ALL HAVING count(*) = 1""")
def sessions_without_copies(spark, sf):
    x = P.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("symbol"), F.to_date("l_shipdate").alias("session")).agg(F.count("*").alias("n"))
    # counting first keeps a busy day from travelling as rows
    return x.where("n = 1")
