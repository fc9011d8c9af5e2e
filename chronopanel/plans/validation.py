"""Bootstraps, folds, decay, overfitting, verdicts, causality."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import features as FE
from ..operators import inference as I
from ..operators import validation as V
from ..sources import panel as P
from . import oracle_parts, windows  # noqa: F401  (the parts that `cut_parts` repeats)
from .catalog import query
from .inference import hac_sql, market_regime, metrics, streams, tests
from .oracle_parts import part
from .tops import rev5

DRAWS, FAMILY_DRAWS = 2_000, 10_000  # of intervals, of tests over a whole family
U = "CAST(('0x' || substring(md5({}),1,8)) AS BIGINT)/4294967296.0"


def paths_sql(draws: int) -> str:
    return f"""
WITH n AS (SELECT count(*) AS n FROM cal), g AS (SELECT rep, pos, n FROM n, (SELECT unnest(generate_series(0,{draws - 1})) AS rep), (SELECT unnest(generate_series(0,(SELECT n-1 FROM n))) AS pos)),
 h AS (SELECT *, CASE WHEN pos = 0 OR {U.format("'42:r:' || rep || ':' || pos")} < 0.1 THEN CAST(floor({U.format("'42:f:' || rep || ':' || pos")}*n) AS BIGINT) - pos END AS step FROM g)
SELECT rep, pos, (pos + last_value(step IGNORE NULLS) OVER (PARTITION BY rep ORDER BY pos)) % n AS idx FROM h"""


part("paths", "cal", paths_sql(DRAWS))
part("family_paths", "cal", paths_sql(FAMILY_DRAWS))
part("ix", "streams", "SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY pos)-1 AS idx, net AS v FROM streams")
part("boot", "paths ix", "SELECT rep, trial, sum(c*v) AS s1, sum(c*v*v) AS s2 FROM (SELECT rep, idx, count(*) AS c FROM paths GROUP BY ALL) JOIN ix USING (idx) GROUP BY rep, trial")
part("family_boot", "family_paths ix", "SELECT rep, trial, sum(c*v) AS s1 FROM (SELECT rep, idx, count(*) AS c FROM family_paths GROUP BY ALL) JOIN ix USING (idx) GROUP BY rep, trial")


def size(spark, sf):
    return P.calendar(spark, sf).count()


def declared_paths(spark, sf, draws):
    """Paths are counters of (rep, pos), so fewer draws are the first of more."""
    return P.kept(spark, sf, f"paths_{draws}", lambda: B.stationary_paths(spark, size(spark, sf), draws))


def declared_counts(spark, sf, draws):
    return P.kept(spark, sf, f"counts_{draws}", lambda: B.date_counts(declared_paths(spark, sf, draws)))


def trial_blocks(spark, sf, most: int = 256) -> int:
    return max(1, -(-family(spark, sf).count() // most))


def declared_intervals(spark, sf):
    def build():
        n = size(spark, sf)
        sums = B.blocked_sums(declared_counts(spark, sf, DRAWS), values(spark, sf), n, trial_blocks=trial_blocks(spark, sf))
        return B.intervals_of_sums(sums, n)

    return P.kept(spark, sf, "intervals_declared", build)


def declared_family_tests(spark, sf):
    m = B.blocked_maxima(declared_counts(spark, sf, FAMILY_DRAWS), values(spark, sf), family(spark, sf), size(spark, sf), trial_blocks=trial_blocks(spark, sf))
    return B.family_p_values(m, family(spark, sf))


def values(spark, sf):
    return P.kept(spark, sf, "ix", lambda: B.indexed(streams(spark, sf), "net"))


@query("STAT-04 STAT-07", "#rep #idx #c", parts="paths", sql="SELECT rep, idx, count(*) AS c FROM paths GROUP BY rep, idx")
def stationary_date_counts(spark, sf):
    return declared_counts(spark, sf, DRAWS)


@query("STAT-04", "#rep #pos #idx", parts="cal", sql=f"""
SELECT rep, pos, (CAST(floor({U.format("'42:b:' || rep || ':' || (pos//10)")}*n) AS BIGINT) + pos % 10) % n AS idx FROM (SELECT count(*) AS n FROM cal), (SELECT unnest(generate_series(0,19)) AS rep), (SELECT unnest(generate_series(0,(SELECT count(*)-1 FROM cal))) AS pos)""")
def moving_block_paths(spark, sf):
    return B.moving_block_paths(spark, size(spark, sf), 20)


@query("STAT-05", "trial #n_reps ~mean_low ~mean_high ~sharpe_low ~sharpe_high", digits=5, parts="boot cal", sql="""
SELECT trial, count(*) AS n_reps, quantile_cont(m,0.025) AS mean_low, quantile_cont(m,0.975) AS mean_high, quantile_cont(sh,0.025) AS sharpe_low, quantile_cont(sh,0.975) AS sharpe_high FROM (
SELECT trial, s1/n AS m, CASE WHEN (s2-s1*s1/n)/(n-1.0) > 1e-18 THEN s1/n/sqrt((s2-s1*s1/n)/(n-1.0))*sqrt(252.0) END AS sh FROM boot, (SELECT count(*) AS n FROM cal)) GROUP BY trial""")
def bootstrap_intervals(spark, sf):
    return declared_intervals(spark, sf)


def family(spark, sf):
    return P.kept(spark, sf, "family", lambda: B.family_inputs(values(spark, sf), size(spark, sf)))


part("fam", "ix cal", """
WITH n AS (SELECT count(*) AS n FROM cal), c AS (SELECT trial, idx, v, v - avg(v) OVER (PARTITION BY trial) AS c FROM ix),
 g AS (SELECT a.trial, b.idx - a.idx AS k, sum(a.c*b.c) AS g FROM c a JOIN c b ON a.trial = b.trial AND b.idx >= a.idx GROUP BY ALL)
SELECT trial, mean, lrv, sqrt(greatest(lrv,0)/n) AS se, mean/sqrt(greatest(lrv,0)/n) AS t,
 CASE WHEN mean >= -sqrt(greatest(lrv,0)/n*2*ln(greatest(ln(n),1))) THEN mean ELSE 0.0 END AS center FROM n, (
 SELECT g.trial, sum(CASE WHEN k = 0 THEN g ELSE 2*g*((1-k/n.n)*power(0.9,k)+(k/n.n)*power(0.9,n.n-k)) END)/any_value(n.n) AS lrv FROM g, n GROUP BY g.trial) JOIN (SELECT trial, avg(v) AS mean FROM ix GROUP BY trial) USING (trial)""")


@query("STAT-10 STAT-11", "best_trial ~best ~spa_p ~reality_p #n_reps", parts="family_boot fam cal", sql="""
SELECT any_value(b.trial) AS best_trial, any_value(b.mean) AS best, avg(CASE WHEN spa > b.mean THEN 1.0 ELSE 0.0 END) AS spa_p, avg(CASE WHEN reality > b.mean THEN 1.0 ELSE 0.0 END) AS reality_p, count(*) AS n_reps FROM (
SELECT rep, max(s1/n - center) AS spa, max(s1/n - mean) AS reality FROM family_boot JOIN fam USING (trial), (SELECT count(*) AS n FROM cal) GROUP BY rep), (SELECT trial, mean FROM fam ORDER BY mean DESC LIMIT 1) b""")
def family_reality_tests(spark, sf):
    return declared_family_tests(spark, sf)


@query("STAT-12", "trial ~t ~raw ~p_rw", digits=5, parts="family_boot fam cal", sql=f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY t DESC, trial) AS k FROM fam),
 x AS (SELECT trial, k, t, max(bt) OVER (PARTITION BY rep ORDER BY k DESC) AS rest FROM (SELECT rep, r.trial, k, t, (s1/n - mean)/se AS bt FROM family_boot JOIN r USING (trial), (SELECT count(*) AS n FROM cal)))
SELECT trial, t, raw, least(1, max(raw) OVER (ORDER BY k)) AS p_rw FROM (SELECT trial, k, t, (1.0 + count(*) FILTER (rest >= t))/{FAMILY_DRAWS + 1}.0 AS raw FROM x GROUP BY trial, k, t)""")
def romano_wolf_stepdown(spark, sf):
    return B.blocked_stepdown(declared_counts(spark, sf, FAMILY_DRAWS), values(spark, sf), family(spark, sf), size(spark, sf), FAMILY_DRAWS)


@query("STAT-06", "trial benchmark ~estimate ~se ~lower ~upper ~p")
def studentized_sharpe_intervals(spark, sf):
    """Each trial alone and against the equal-weight market; a set of paths for each number of sessions."""
    from .portfolios import market_legs

    market = market_legs(spark, sf).where("leg = 'CLOSE_TO_CLOSE' and r is not null").select(F.lit("MARKET").alias("benchmark"), "pos", F.col("r").alias("b"))
    pairs = P.kept(spark, sf, "sharpe-pairs", lambda: B.paired_arrays(streams(spark, sf), "net", market))
    out = None
    for (n,) in pairs.select(F.size("xs")).distinct().collect():
        of = B.stationary_paths(spark, n, DRAWS)
        part_ = B.studentized_sharpe(pairs.where(F.size("xs") == n), of, 7)
        out = part_ if out is None else out.unionByName(part_)
    return out


@query("UDF-02", "trial #rep ~statistic")
def user_statistic_of_resamples(spark, sf):
    return B.resampled_statistic(declared_counts(spark, sf, DRAWS), values(spark, sf), lambda x: float(abs(x).mean()))


part("folds", "cal", """
SELECT k AS fold, CAST(lo + to_years(CAST(3+k AS INTEGER)) AS DATE) AS test_start, CAST(lo + to_years(CAST(4+k AS INTEGER)) AS DATE) AS test_stop
FROM (SELECT min(session) AS lo, max(session) AS hi FROM cal), (SELECT unnest(generate_series(0,20)) AS k) WHERE CAST(lo + to_years(CAST(3+k AS INTEGER)) AS DATE) <= hi""")


def folds(spark, sf):
    return V.expanding_folds(P.calendar(spark, sf), 3)


@query("VAL-01", "#fold side #n first_session last_session", parts="folds cal", sql="""
SELECT fold, CASE WHEN session < test_start THEN 'train' ELSE 'test' END AS side, count(*) AS n, min(session) AS first_session, max(session) AS last_session
FROM cal JOIN folds ON session < test_stop GROUP BY ALL""")
def walk_forward_folds(spark, sf):
    return V.fold_rows(P.calendar(spark, sf), folds(spark, sf)).groupBy("fold", "side").agg(
        F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@query("VAL-02", "trial #n_folds ~positive_fraction #n_oos ~oos_mean ~oos_t majority significant", digits=5, parts="streams folds", sql=f"""
WITH {hac_sql("SELECT trial, pos, net AS v FROM streams JOIN folds ON session >= test_start AND session < test_stop", "trial", 5)},
 p AS (SELECT trial, count(*) AS n_folds, avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS positive_fraction FROM (SELECT trial, fold, avg(net) AS m FROM streams JOIN folds ON session >= test_start AND session < test_stop GROUP BY trial, fold) GROUP BY trial)
SELECT trial, n_folds, positive_fraction, n AS n_oos, mean AS oos_mean, t AS oos_t, positive_fraction > 0.5 AS majority, t > 2 AS significant FROM p JOIN hac USING (trial)""")
def walk_forward_evidence(spark, sf):
    return evidence(spark, sf)


def evidence(spark, sf):
    return P.kept(spark, sf, "evidence", lambda: V.walk_forward_verdict(streams(spark, sf), folds(spark, sf), "net", 5))


def sides(spark, sf):
    return P.kept(spark, sf, "sides", lambda: V.split_sides(spark, size(spark, sf)))


part("sides", "cal", """
WITH n AS (SELECT count(*) AS n FROM cal), r AS (SELECT pos-1 AS i, CASE WHEN pos-1 < (n%6)*(n//6+1) THEN (pos-1)//(n//6+1) ELSE n%6 + (pos-1-(n%6)*(n//6+1))//(n//6) END AS g FROM cal, n),
 p AS (SELECT a.g AS g1, b.g AS g2, row_number() OVER (ORDER BY a.g, b.g)-1 AS split FROM (SELECT DISTINCT g FROM r) a JOIN (SELECT DISTINCT g FROM r) b ON a.g < b.g),
 t AS (SELECT split, i, true AS test FROM p JOIN r ON r.g IN (g1, g2))
SELECT p.split, r.i, CASE WHEN t.test THEN 'test' ELSE 'train' END AS side FROM p CROSS JOIN r LEFT JOIN t ON t.split = p.split AND t.i = r.i
WHERE t.test OR NOT EXISTS (SELECT 1 FROM t u WHERE u.split = p.split AND u.i BETWEEN r.i - 21 AND r.i + 21)""")


@query("VAL-03", "#split side #n", parts="sides", sql="SELECT split, side, count(*) AS n FROM sides GROUP BY ALL")
def combinatorial_purged_splits(spark, sf):
    return sides(spark, sf).groupBy("split", "side").agg(F.count("*").alias("n"))


part("pbos", "sides ix", """
WITH s0 AS (SELECT split, trial, side, avg(v)/nullif(stddev_samp(v),0) AS sh FROM ix JOIN sides ON i = idx GROUP BY ALL),
 s AS (SELECT * FROM s0 WHERE trial NOT IN (SELECT trial FROM s0 WHERE sh IS NULL)),
 w AS (SELECT a.split, a.trial, a.sh AS train, b.sh AS test FROM s a JOIN s b ON a.split = b.split AND a.trial = b.trial AND a.side = 'train' AND b.side = 'test')
SELECT split, trial AS selected, pct, ln(pct/(1-pct)) AS logit FROM (SELECT a.split, a.trial, (count(*) FILTER (b.test < a.test) + (count(*) FILTER (b.test = a.test) + 1)/2.0)/count(*) AS pct
 FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY split ORDER BY train DESC, trial) = 1) a JOIN w b ON a.split = b.split GROUP BY a.split, a.trial)""")


@query("VAL-04", "#split selected ~pct ~logit", digits=5, parts="pbos", sql="SELECT split, selected, pct, CASE WHEN pct < 1 THEN logit ELSE ln((1-2.220446049250313e-16)/2.220446049250313e-16) END AS logit FROM pbos")
def overfitting_splits(spark, sf):
    return V.overfitting(V.split_performance(streams(spark, sf), sides(spark, sf)))


@query("VAL-04 ASM-10", "#n_splits ~pbo", parts="pbos", sql="SELECT count(*) AS n_splits, avg(CASE WHEN pct <= 0.5 THEN 1.0 ELSE 0.0 END) AS pbo FROM pbos")
def overfitting_probability(spark, sf):
    return V.pbo(overfitting_splits(spark, sf))


@query("VAL-05", "#fold side #n first_session last_session", parts="folds grid", sql="""
WITH f AS (SELECT symbol, session, lead(session,6) OVER (PARTITION BY symbol ORDER BY pos) AS label_end, px FROM grid),
 r AS (SELECT f.*, fold, test_start, CASE WHEN session < test_start THEN 'train' ELSE 'test' END AS side FROM f JOIN folds ON session < test_stop WHERE px IS NOT NULL),
 d AS (SELECT fold, session, row_number() OVER (PARTITION BY fold ORDER BY session DESC) AS back FROM (SELECT DISTINCT fold, session FROM r WHERE side = 'train' AND label_end < test_start))
SELECT fold, side, count(*) AS n, min(session) AS first_session, max(session) AS last_session FROM r WHERE side = 'test' OR (label_end < test_start AND (fold, session) IN (SELECT (fold, session) FROM d WHERE back > 5)) GROUP BY ALL""")
def purged_panel_folds(spark, sf):
    ends = P.calendar(spark, sf).select((F.col("pos") - 6).alias("pos"), F.col("session").alias("label_end"))
    frame = P.placed(spark, sf).select("symbol", "session", "pos").join(ends, "pos", "left")
    return V.purged_panel_folds(frame, folds(spark, sf)).groupBy("fold", "side").agg(
        F.count("*").alias("n"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))


@query("VAL-06", "session #n ~ic ~spread", digits=5, parts="rev5 rets", sql="""
WITH x AS (SELECT v.session, v.symbol, v.rev AS p, n.ret AS r FROM rev5 v JOIN rets n ON n.symbol = v.symbol AND n.pos = v.pos + 1 WHERE v.rev IS NOT NULL AND n.ret IS NOT NULL),
 y AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY p) + (count(*) OVER (PARTITION BY session, p)-1)/2.0 AS a, rank() OVER (PARTITION BY session ORDER BY r) + (count(*) OVER (PARTITION BY session, r)-1)/2.0 AS b,
  row_number() OVER (PARTITION BY session ORDER BY p DESC, symbol) AS t, row_number() OVER (PARTITION BY session ORDER BY p, symbol) AS u FROM x)
SELECT session, count(*) AS n, corr(a,b) AS ic, avg(r) FILTER (t <= 3) - avg(r) FILTER (u <= 3) AS spread FROM y GROUP BY session HAVING count(*) >= 6""")
def ranking_diagnostics(spark, sf):
    nxt = P.with_returns(spark, sf).where("ret is not null").select("symbol", (F.col("pos") - 1).alias("pos"), F.col("ret").alias("next"))
    frame = rev5(spark, sf).select("symbol", "session", "pos", "rev").join(nxt, ["symbol", "pos"])
    return V.ranking_diagnostics(frame, "rev", "next", 3)


DECAY = """WITH w AS (SELECT k AS w, CAST(lo + to_months(CAST(12*k AS INTEGER)) AS DATE) AS start, CAST(lo + to_months(CAST(12*k+{0} AS INTEGER)) AS DATE) AS stop FROM (SELECT min(session) AS lo, max(session) AS hi FROM cal), (SELECT unnest(generate_series(0,30)) AS k)
 WHERE CAST(lo + to_months(CAST(12*k+{0} AS INTEGER)) AS DATE) <= hi + 1 AND k % {1} = 0), """
ROWS = "SELECT trial, w, pos, net AS v FROM streams JOIN w ON session >= start AND session < stop"


def points(spark, sf, step):
    return P.kept(spark, sf, f"decay{step}", lambda: V.decay_points(streams(spark, sf), 2, step, "net", 5))


@query("VAL-07", "trial #w #n ~mean ~t", digits=5, parts="streams cal", sql=DECAY.format(24, 1) + hac_sql(ROWS, "trial, w", 5) + " SELECT trial, w, n, mean, t FROM hac WHERE n >= 100")
def rolling_decay(spark, sf):
    return points(spark, sf, 12)


@query("VAL-08", "trial #n ~mean ~t", digits=5, parts="streams cal", sql=DECAY.format(24, 2) + hac_sql(ROWS, "trial, w", 5) + " SELECT trial, n, mean, t FROM hac WHERE n >= 100")
def fixed_decay(spark, sf):
    return points(spark, sf, 24)


def decay(spark, sf):
    return P.kept(spark, sf, "decay", lambda: V.classify_decay(points(spark, sf, 12), points(spark, sf, 24)))


@query("VAL-09", "trial #n_windows ~stability ~ratio decay", digits=5, parts="streams cal", sql=DECAY.format(24, 1) + hac_sql(ROWS, "trial, w", 5) + """,
 x AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY w DESC) AS r FROM hac WHERE n >= 100),
 s AS (SELECT trial, count(*) AS n_windows, max(mean) FILTER (r = 1) AS last_mean, quantile_cont(mean,0.5) FILTER (r > 1) AS prior, quantile_cont(mean,0.5) FILTER (r > 2 AND t > 3) AS strong,
  max(abs(t)) FILTER (r <= 2) AS rt, max(abs(mean)) FILTER (r <= 2) AS rm, (count(*) FILTER (mean > 0) + count(*) FILTER (mean > 0 AND w % 2 = 0))/(count(*) + count(*) FILTER (w % 2 = 0)) AS stability FROM x GROUP BY trial)
SELECT trial, n_windows, stability, CASE WHEN prior > 0 THEN last_mean/prior END AS ratio, CASE WHEN n_windows >= 3 AND strong IS NOT NULL AND rt < 1 AND rm <= 0.25*abs(strong) THEN 'DEAD'
 WHEN stability >= 0.75 AND last_mean > 0 AND prior > 0 AND last_mean/prior >= 0.5 THEN 'STABLE' WHEN last_mean > 0 AND prior > 0 AND last_mean/prior < 0.5 THEN 'DECAYING' ELSE 'INSUFFICIENT' END AS decay FROM s""")
def decay_classes(spark, sf):
    return decay(spark, sf)


@query("VAL-09", "trial ~p_interaction ~active_t decay", digits=5)
def decay_classes_by_regime(spark, sf):
    """Decay classes with the market regime's interaction, adjusted over the family."""
    return regime_decay(spark, sf)


def regime_decay(spark, sf):
    def build():
        evidence_ = V.regime_evidence(streams(spark, sf), market_regime(spark, sf), "net", 5)
        return V.classify_decay(points(spark, sf, 12), points(spark, sf, 24), regime=evidence_)

    return P.kept(spark, sf, "regime-decay", build)


@query("VAL-10", "symbol ~t_base ~t_shifted collapses", digits=5, parts="rets", sql="WITH " + hac_sql("""SELECT symbol, lagk, pos, coalesce(lag(s, lagk) OVER (PARTITION BY symbol, lagk ORDER BY pos),0)*coalesce(ret,0) AS v FROM (SELECT symbol, pos, ret, coalesce(sign(lead(ret) OVER (PARTITION BY symbol ORDER BY pos)),0) AS s FROM rets), (VALUES (1),(2)) t(lagk)""", "symbol, lagk") + """
SELECT a.symbol, a.t AS t_base, b.t AS t_shifted, a.t > 3 AND abs(b.t) < 1.96 AS collapses FROM hac a JOIN hac b ON a.symbol = b.symbol AND a.lagk = 1 AND b.lagk = 2""")
def shift_and_collapse(spark, sf):
    from ..operators.causality import shift_collapse

    return shift_collapse(P.grid(spark, sf))


@query("VAL-11 STR-01 UDF-04", "#n_rows #n_changed causal", parts="rev5", sql="SELECT count(*) AS n_rows, 0 AS n_changed, true AS causal FROM rev5 WHERE session < DATE '1999-01-04'")
def prefix_replay(spark, sf):
    cut = "1999-01-04"
    feature = lambda d: d.select("symbol", "session", FE.reversal(5).alias("rev"))
    base = P.placed(spark, sf)
    broken = V.prefix_breaks(feature, base, cut).agg(F.count("*").alias("n_changed"))
    rows = base.where(F.col("session") < F.lit(cut).cast("date")).agg(F.count("*").alias("n_rows"))
    return rows.join(broken).withColumn("causal", F.col("n_changed") == 0)


# The whole chain from returns to entries once more, on a panel without its last sessions.
def cut_parts() -> None:
    chain = ("rets", "mkt", "peers", "betas", "reversals", "entries")
    for name in chain[1:]:
        needs, text = oracle_parts.PARTS[name]
        for other in chain:
            text = re.sub(rf"\b{other}\b(?!_)", f"{other}_cut", text)
            needs = re.sub(rf"\b{other}\b(?!_)", f"{other}_cut", needs)
        part(f"{name}_cut", needs, text)


part("rets_cut", "rets cal", "SELECT * FROM rets WHERE pos <= (SELECT max(pos) - 25 FROM cal)")
cut_parts()
part("cube_later", oracle_parts.PARTS["cube"][0], oracle_parts.PARTS["cube"][1].replace("6 PRECEDING AND 2 PRECEDING", "7 PRECEDING AND 3 PRECEDING"))
part("streams_later", "cube_later", oracle_parts.PARTS["streams"][1].replace("FROM cube", "FROM cube_later"))
HELD = "SELECT trial, symbol, pos+2+k AS pos, sum(CASE WHEN k < 5 THEN weight/5 ELSE 0 END) AS weight FROM {} CROSS JOIN (SELECT unnest(generate_series(0,5)) AS k) WHERE pos+2+k <= (SELECT max(pos) - 50 FROM cal) GROUP BY ALL"


@query("VAL-11", "trial #n_compared #n_changed ~baseline_t ~extra_lag_t lag_inflation reason causal", digits=5, parts="streams streams_later entries entries_cut cal", sql="WITH " + hac_sql("SELECT trial, 'a' AS leg, pos, net AS v FROM streams UNION ALL SELECT trial, 'b', pos, net FROM streams_later", "trial, leg", 5) + f""",
 t AS (SELECT trial, max(CASE WHEN leg = 'a' THEN t END) AS baseline_t, max(CASE WHEN leg = 'b' THEN t END) AS extra_lag_t FROM hac GROUP BY trial),
 d AS (SELECT coalesce(a.trial, b.trial) AS trial, count(a.weight) AS n_compared, count(*) FILTER (NOT coalesce(abs(a.weight-b.weight) <= 1e-12, false)) AS n_changed FROM ({HELD.format('entries')}) a FULL JOIN ({HELD.format('entries_cut')}) b ON a.trial = b.trial AND a.symbol = b.symbol AND a.pos = b.pos GROUP BY 1),
 r AS (SELECT t.*, coalesce(n_compared,0) AS n_compared, coalesce(n_changed,0) AS n_changed, coalesce(extra_lag_t > baseline_t + 1, false) AS lag_inflation FROM t LEFT JOIN d USING (trial))
SELECT *, CASE WHEN n_changed > 0 THEN 'CHANGED_WITHOUT_THE_FUTURE' WHEN lag_inflation THEN 'STRONGER_WITH_EXTRA_LAG' ELSE 'PASSED' END AS reason, n_changed = 0 AND NOT lag_inflation AS causal FROM r""")
def survivor_causality(spark, sf):
    """Every trial's signals rebuilt from a panel without its last sessions, and its fills one session later."""
    from ..operators import streams as S
    from ..operators.causality import survivor_causality as check
    from .inference import market

    m, cal = market(spark, sf), P.calendar(spark, sf)
    panel = P.placed(spark, sf)
    build = lambda d, lag: S.positions(S.reversal_entries(FE.reversal_signals(P.returns_of(d))), 5, lag)
    return check(build, lambda x: S.evaluate(x, m, cal), panel, size(spark, sf), 5, 2)


@query("VAL-12 FUN-17", "leg #n_rows #late #early_fills", parts="bars", sql="""
SELECT leg, count(*) AS n_rows, count(*) FILTER (nxt IS NOT NULL AND av >= nxt) AS late, count(*) FILTER (CASE leg WHEN 'SAME_CLOSE' THEN own ELSE nxt END <= av) AS early_fills
FROM (SELECT session + INTERVAL 16 HOUR AS own, session + INTERVAL 16 HOUR + INTERVAL 15 MINUTE AS av, lead(session) OVER (PARTITION BY symbol ORDER BY session) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS nxt FROM bars), (VALUES ('SAME_CLOSE'),('NEXT_OPEN')) t(leg) GROUP BY leg""")
def availability_assertions(spark, sf):
    """Fills at the close that made the signal come before it; fills at the next open must not."""
    from ..operators.causality import availability_report

    return availability_report(P.bars(spark, sf))


def verdict_table(spark, sf):
    """Every trial with the evidence of all gates: own test, family-wide rates, out-of-sample folds, decay, overfitting
    of the family and the independent recomputation. Rotated and opposite trials are controls."""
    def build():
        m = I.benjamini_hochberg(metrics(spark, sf), "p").select("trial", "n", "mean", "t", "enough", "sharpe", "p_bh", "dsr")
        one_row = V.pbo(overfitting_splits(spark, sf)).select("pbo").join(declared_family_tests(spark, sf).select("spa_p"))
        gross = streams(spark, sf).groupBy("trial").agg(F.avg("gross").alias("gross_mean"))
        x = m.join(evidence(spark, sf).select("trial", "oos_t", "positive_fraction"), "trial").join(regime_decay(spark, sf).select("trial", "decay", "stability"), "trial", "left")
        x = x.join(gross, "trial").join(independent_recomputation(spark, sf).select("trial", "agrees"), "trial", "left").join(F.broadcast(one_row))
        return V.verdicts(x.withColumn("is_control", F.col("trial").rlike("ROTATED|OPPOSITE|PLACEBO")))

    return P.kept(spark, sf, "verdicts", build)


@query("VAL-15 STAT-22", "trial verdict reasons")
def verdict_precedence(spark, sf):
    return verdict_table(spark, sf)


@query("AGG-16", "verdict #n")
def verdict_funnel(spark, sf):
    return verdict_table(spark, sf).rollup("verdict").agg(F.count("*").alias("n")).withColumn("verdict", F.coalesce("verdict", F.lit("ALL")))


@query("VAL-14 STAT-21", "trial ~mean ~t ~oos_t decay ~mean_low ~mean_high ~slope verdict", digits=5)
def validation_table(spark, sf):
    x = verdict_table(spark, sf).join(declared_intervals(spark, sf).select("trial", "mean_low", "mean_high"), "trial")
    reg = I.regime_interaction(streams(spark, sf).join(market_regime(spark, sf), "pos"), ["trial"], "pos", "net", "on").select("trial", "slope")
    return x.join(reg, "trial")


SEALED = "2001-01-01"
part("sealed_days", "cal", f"SELECT session, pos, row_number() OVER (ORDER BY pos)-1 AS idx FROM cal WHERE session >= DATE '{SEALED}'")
part("frozen", "streams", f"""
WITH RECURSIVE s AS (SELECT * FROM streams WHERE session < DATE '{SEALED}' AND trial IN (SELECT trial FROM streams WHERE session < DATE '{SEALED}' GROUP BY trial HAVING avg(net) > 0)),
 e AS (SELECT a.trial AS x, b.trial AS y FROM s a JOIN s b ON a.pos = b.pos GROUP BY ALL HAVING abs(corr(a.net, b.net)) >= 0.7),
 reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y), c AS (SELECT x AS trial, min(y) AS cluster FROM reach GROUP BY x)
SELECT trial, 1.0/(SELECT count(DISTINCT cluster) FROM c)/count(*) OVER (PARTITION BY cluster) AS weight FROM c""")
part("sealed_values", "frozen streams sealed_days mkt", """
WITH i AS (SELECT s.trial, s.pos, idx, net, weight FROM streams s JOIN frozen USING (trial) JOIN sealed_days w ON w.pos = s.pos),
 c AS (SELECT pos, idx, sum(net*weight) AS v FROM i GROUP BY ALL),
 g AS (SELECT pos, coalesce(lag(lvl > avg20) OVER (ORDER BY pos), false) AS on_, lag(avg20) OVER (ORDER BY pos) AS a FROM (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(lvl) OVER w END AS avg20 FROM (SELECT pos, round(sum(coalesce(mkt,0)) OVER (ORDER BY pos), 9) AS lvl FROM mkt) WINDOW w AS (ORDER BY pos ROWS 19 PRECEDING)))
SELECT 'EDGE' AS kind, trial AS series, idx, net AS v FROM i UNION ALL SELECT 'COMPOSITE', 'ALL', idx, v FROM c
UNION ALL SELECT 'OVERLAY', 'TREND', idx, CASE WHEN on_ THEN 0.0 ELSE -v END FROM c JOIN g USING (pos) WHERE a IS NOT NULL""")
part("sealed_draws", "sealed_days", f"""
WITH n AS (SELECT count(*) AS n FROM sealed_days), g AS (SELECT rep, pos, n FROM n, (SELECT unnest(generate_series(0,{DRAWS - 1})) AS rep), (SELECT unnest(generate_series(0,(SELECT n-1 FROM n))) AS pos)),
 h AS (SELECT *, pos = 0 OR {U.format("'42:r:' || rep || ':' || pos")} < 0.1 AS restart, CAST(floor({U.format("'42:f:' || rep || ':' || pos")}*n) AS BIGINT) AS fresh FROM g),
 k AS (SELECT *, max(CASE WHEN restart THEN pos END) OVER (PARTITION BY rep ORDER BY pos) AS at FROM h)
SELECT rep, idx, count(*) AS c FROM (SELECT k.rep, (h.fresh + k.pos - k.at) % k.n AS idx FROM k JOIN h ON h.rep = k.rep AND h.pos = k.at) GROUP BY ALL""")
part("sealed", "sealed_values sealed_draws sealed_days", """
WITH b AS (SELECT kind, series, rep, sum(c*v)/(SELECT count(*) FROM sealed_days) AS m, sum(c*v) AS s1, sum(c*v*v) AS s2, (SELECT count(*) FROM sealed_days) AS n FROM sealed_values JOIN sealed_draws USING (idx) GROUP BY kind, series, rep),
 q AS (SELECT kind, series, quantile_cont(m,0.025) AS mean_low, quantile_cont(m,0.975) AS mean_high, quantile_cont(sh,0.025) AS sharpe_low, quantile_cont(sh,0.975) AS sharpe_high FROM (SELECT *, CASE WHEN (s2-s1*s1/n)/(n-1.0) > 1e-18 THEN m/sqrt((s2-s1*s1/n)/(n-1.0))*sqrt(252.0) END AS sh FROM b) GROUP BY ALL)
SELECT kind, series, count(*) AS n, avg(v) AS mean, CASE WHEN count(*) >= 20 THEN any_value(mean_low) END AS mean_low, CASE WHEN count(*) >= 20 THEN any_value(mean_high) END AS mean_high,
 CASE WHEN count(*) >= 20 THEN any_value(sharpe_low) END AS sharpe_low, CASE WHEN count(*) >= 20 THEN any_value(sharpe_high) END AS sharpe_high FROM sealed_values JOIN q USING (kind, series) GROUP BY kind, series""")


def sealed(spark, sf):
    """Edges frozen before the window, their composite and the trend overlay, on one set of declared draws."""
    from ..operators import holdout as H

    def build():
        cal = P.calendar(spark, sf).where(F.col("session") >= F.lit(SEALED).cast("date"))
        window = cal.select("pos", (F.row_number().over(W.orderBy("pos")) - 1).alias("idx"))
        overlays = market_regime(spark, sf).select(F.lit("TREND").alias("overlay"), "pos", "on")
        frozen = P.kept(spark, sf, "frozen-edges", lambda: H.frozen_edges(streams(spark, sf), SEALED))
        return H.evaluate(P.kept(spark, sf, "sealed-series", lambda: H.sealed_series(streams(spark, sf), frozen, overlays, SEALED)), window, DRAWS)

    return P.kept(spark, sf, "sealed", build)


@query("VAL-17 ASM-11", "kind series #n ~mean ~mean_low ~mean_high ~sharpe_low ~sharpe_high", digits=5, parts="sealed", sql="SELECT * FROM sealed")
def sealed_window_evaluation(spark, sf):
    return sealed(spark, sf)


GATE = """
WITH g AS (SELECT count(*) FILTER (kind = 'EDGE') AS n_edges, coalesce(bool_and(mean > 0) FILTER (kind = 'EDGE'), true) AS edge_positive, count(*) FILTER (kind = 'EDGE') = 0 OR coalesce(bool_and(mean > 0) FILTER (kind = 'COMPOSITE'), false) AS composite_positive,
 coalesce(bool_and(mean >= 0) FILTER (kind = 'OVERLAY'), true) AS overlays_nonnegative, coalesce(bool_and(coalesce(mean_low > 0, false)) FILTER (kind = 'EDGE'), true) AS e_low, count(*) FILTER (kind = 'EDGE') = 0 OR coalesce(bool_and(coalesce(mean_low > 0, false)) FILTER (kind = 'COMPOSITE'), false) AS c_low FROM sealed),
 d AS (SELECT 'SIGN_V1' AS evaluator, n_edges, edge_positive, composite_positive, overlays_nonnegative, CAST(NULL AS BOOLEAN) AS edge_low_positive, CAST(NULL AS BOOLEAN) AS composite_low_positive, edge_positive AND composite_positive AND overlays_nonnegative AS research_gate_pass FROM g
 UNION ALL SELECT 'CI_V2', n_edges, edge_positive, composite_positive, overlays_nonnegative, e_low, c_low, edge_positive AND composite_positive AND overlays_nonnegative AND e_low AND c_low FROM g)"""


@query("VAL-16", "evaluator #n_edges edge_positive composite_positive overlays_nonnegative edge_low_positive composite_low_positive research_gate_pass promoted", parts="sealed", sql=GATE + " SELECT *, research_gate_pass AND n_edges > 0 AS promoted FROM d")
def sealed_window_gate(spark, sf):
    from ..operators import holdout as H

    return H.decide(sealed(spark, sf))


@query("VAL-16", "sealed_pass ci_v2_would_pass edge_low_positive composite_low_positive", parts="sealed", sql=GATE + """
SELECT a.research_gate_pass AS sealed_pass, b.research_gate_pass AS ci_v2_would_pass, b.edge_low_positive, b.composite_low_positive FROM d a, d b WHERE a.evaluator = 'SIGN_V1' AND b.evaluator = 'CI_V2'""")
def sealed_window_diagnostic(spark, sf):
    from ..operators import holdout as H

    return H.diagnostic(H.decide(sealed(spark, sf)))


@query("VAL-18", "trial ~fold_total ~stream_total agrees", digits=5, parts="entries rets streams", sql="""
SELECT trial, fold_total, stream_total, abs(fold_total - stream_total) < 1e-6 AS agrees FROM (SELECT e.trial, sum(e.weight*r.ret)/5 AS fold_total FROM entries e JOIN rets r ON r.symbol = e.symbol AND r.pos BETWEEN e.pos+2 AND e.pos+6 GROUP BY 1) JOIN (SELECT trial, sum(gross) AS stream_total FROM streams GROUP BY 1) USING (trial)""")
def independent_recomputation(spark, sf):
    from ..operators.causality import recompute_gross
    from ..operators.streams import reversal_entries
    from .inference import market, signals

    return recompute_gross(reversal_entries(signals(spark, sf)), market(spark, sf), streams(spark, sf), 5, 2)


@query("VAL-18", "trial #trades #vector_trades ~net_mean ~vector_mean count_match passed", digits=8, parts="flags mkt", sql="""
WITH s AS (SELECT f.pos, t.trial, CASE t.trial WHEN 'OPEX|SHORT' THEN CASE WHEN opex_week THEN -1.0 ELSE 0.0 END WHEN 'TOM|LONG' THEN CASE WHEN turn_of_month THEN 1.0 ELSE 0.0 END WHEN 'WEEKDAY|BOTH' THEN CASE WHEN weekday = 0 THEN -1.0 WHEN weekday = 4 THEN 1.0 ELSE 0.0 END ELSE 1.0 END AS x FROM flags f CROSS JOIN (VALUES ('OPEX|SHORT'),('TOM|LONG'),('WEEKDAY|BOTH'),('ALWAYS|LONG')) t(trial)),
 p AS (SELECT trial, pos, coalesce(lag(x) OVER (PARTITION BY trial ORDER BY pos),0) AS p FROM s),
 d AS (SELECT trial, pos, p, abs(p - coalesce(lag(p) OVER (PARTITION BY trial ORDER BY pos),0)) AS c FROM p),
 v AS (SELECT trial, count(*) FILTER (c > 0) AS vector_trades, avg(p*coalesce(mkt,0) - 0.0003*c) AS vector_mean, count(*) AS n FROM d JOIN mkt USING (pos) GROUP BY trial),
 g AS (SELECT *, sum(CASE WHEN x IS DISTINCT FROM y THEN 1 ELSE 0 END) OVER (PARTITION BY trial ORDER BY pos) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY trial ORDER BY pos) AS y FROM s)),
 r AS (SELECT trial, run, any_value(x) AS x, min(pos) AS first, max(pos) AS last FROM g GROUP BY trial, run),
 q AS (SELECT r.*, abs(x - coalesce(lag(x) OVER (PARTITION BY trial ORDER BY run),0)) AS c FROM r),
 o AS (SELECT q.trial, count(DISTINCT CASE WHEN c > 0 THEN run END) AS trades, sum(x*e) - sum(0.0003*c) AS total FROM (SELECT q.trial, run, x, c, sum(coalesce(m.mkt,0)) AS e FROM q JOIN mkt m ON m.pos > q.first AND m.pos <= q.last + 1 GROUP BY ALL) q GROUP BY q.trial)
SELECT trial, trades, vector_trades, total/n AS net_mean, vector_mean, trades = vector_trades AS count_match, trades = vector_trades AND abs(total/n - vector_mean)*1e4*n/greatest(trades,1) <= 1 AS passed FROM v JOIN o USING (trial)""")
def confirmed_scalar_strategies(spark, sf):
    """Calendar rules on the market, from daily rows and from their trades."""
    from ..operators.causality import confirm_scalars

    f = P.calendar_table(spark, sf)
    x = {"OPEX|SHORT": F.when(F.col("opex_week"), -1.0).otherwise(0.0), "TOM|LONG": F.when(F.col("turn_of_month"), 1.0).otherwise(0.0),
         "WEEKDAY|BOTH": F.when(F.col("weekday") == 0, -1.0).when(F.col("weekday") == 4, 1.0).otherwise(0.0), "ALWAYS|LONG": F.lit(1.0)}
    s = f.select("pos", F.inline(F.array(*[F.struct(F.lit(k).alias("trial"), v.alias("signal")) for k, v in x.items()])))
    m = FE.market_return(P.with_returns(spark, sf)).select("pos", F.coalesce("mkt", F.lit(0.0)).alias("ret"))
    return confirm_scalars(s, m, 0.0003)


@query("STAT-24", "family #parameter ~score plateau", parts="summ", digits=5, sql="""
WITH x AS (SELECT split_part(trial,'|',1) || '|' || split_part(trial,'|',3) AS family, CAST(split_part(trial,'|',2) AS INTEGER) AS parameter, sharpe AS score FROM summ),
 y AS (SELECT *, score > 0 AND score >= 0.8*max(score) OVER (PARTITION BY family) AS ok FROM x)
SELECT family, parameter, score, ok AND (coalesce(lead(ok) OVER w, false) OR coalesce(lag(ok) OVER w, false)) AS plateau FROM y WINDOW w AS (PARTITION BY family ORDER BY parameter)""")
def parameter_plateaus(spark, sf):
    from ..operators.causality import plateaus

    s = F.split("trial", "\\|")
    x = I.summarize(streams(spark, sf), ["trial"], "net").select(
        F.concat_ws("|", s[0], s[2]).alias("family"), s[1].cast("int").alias("parameter"), F.col("sharpe").alias("score"))
    return plateaus(x)
