"""Ranking and top-k queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import crosssec as X
from ..operators import features as FE
from ..operators.advisor import latest
from ..session import scratch_path
from ..sources import panel as P
from .catalog import query
from .oracle_parts import part

part("rev5", "grid", "SELECT *, -(px/lag(px,5) OVER (PARTITION BY symbol ORDER BY pos)-1) AS rev FROM grid QUALIFY px IS NOT NULL")
part("deciles", "rev5", """
SELECT *, coalesce(l/nullif(sum(l) OVER s,0),0) - coalesce(sh/nullif(sum(sh) OVER s,0),0) AS weight FROM (
SELECT *, CASE WHEN pct > 0.9 THEN 1.0 ELSE 0.0 END AS l, CASE WHEN pct <= 0.1 THEN 1.0 ELSE 0.0 END AS sh FROM (
SELECT *, CASE WHEN rev IS NOT NULL AND count(rev) OVER (PARTITION BY session) >= 2 THEN
 (rank() OVER (PARTITION BY session ORDER BY rev NULLS LAST) + (count(rev) OVER (PARTITION BY session, rev)-1)/2.0) / count(rev) OVER (PARTITION BY session) END AS pct
FROM rev5)) WINDOW s AS (PARTITION BY session)""")


def rev5(spark, sf):
    return P.kept(spark, sf, "rev5", lambda: P.with_returns(spark, sf).withColumn("rev", FE.reversal(5)))


@query("TOP-01 TOP-02 ML-02", "symbol session ~pct ~weight", parts="deciles", sql="SELECT symbol, session, pct, weight FROM deciles")
def decile_long_short_weights(spark, sf):
    x = rev5(spark, sf).withColumn("pct", X.percent_rank_average("rev"))
    return X.decile_weights(x, "rev")


@query("TOP-03", "symbol session #k side ~weight", parts="rev5", sql="""
SELECT symbol, session, k, side, CASE side WHEN 'LONG' THEN 1.0 ELSE -1.0 END / k AS weight FROM (
SELECT *, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS a, row_number() OVER (PARTITION BY session ORDER BY rev, symbol) AS b,
 count(*) OVER (PARTITION BY session) AS n FROM rev5 WHERE rev IS NOT NULL) CROSS JOIN (VALUES (1),(3),(5)) t(k) CROSS JOIN (VALUES ('LONG'),('SHORT')) s(side)
WHERE n >= k AND CASE side WHEN 'LONG' THEN a ELSE b END <= k""")
def top_k_side_weights(spark, sf):
    return X.top_k_entries(rev5(spark, sf).select("symbol", "session", "rev"), "rev", (1, 3, 5))


@query("TOP-04", "symbol session #rank #names", parts="rev5 cal", sql="""
SELECT symbol, session, rank, names FROM (SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS rank,
 floor(count(*) OVER (PARTITION BY session)/5) AS names FROM rev5 WHERE rev IS NOT NULL AND asset_type = 'equity'
 AND session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))) WHERE rank <= names AND names >= 2""")
def monthly_top_fraction(spark, sf):
    x = X.month_end_rows(rev5(spark, sf).where("asset_type = 'equity'"), P.calendar(spark, sf))
    return X.top_fraction(x, "rev", 5, 2, ascending=False)


@query("TOP-05", "cohort symbol side #day_offset ~ret", parts="rev5 rets cal", sql="""
SELECT c.session AS cohort, c.symbol, c.side, r.pos - c.pos AS day_offset, r.ret FROM (
SELECT * FROM (SELECT symbol, session, pos, CASE WHEN a <= 5 THEN 'TOP' WHEN b <= 5 THEN 'BOTTOM' END AS side, n FROM (
 SELECT *, row_number() OVER (PARTITION BY session ORDER BY rev DESC, symbol) AS a, row_number() OVER (PARTITION BY session ORDER BY rev, symbol) AS b,
 count(*) OVER (PARTITION BY session) AS n FROM rev5 WHERE rev IS NOT NULL AND session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))))
 WHERE side IS NOT NULL AND n >= 10) c JOIN rets r ON r.symbol = c.symbol AND r.pos > c.pos AND r.pos <= c.pos + 21 AND r.ret IS NOT NULL""")
def month_end_cohort_paths(spark, sf):
    from ..operators.cohorts import cohort_members, cohort_paths

    members = cohort_members(X.month_end_rows(rev5(spark, sf), P.calendar(spark, sf)), "rev", 5, 10)
    return cohort_paths(members, P.with_returns(spark, sf), 21)


part("latest_rev", "rev5", "SELECT * FROM rev5 WHERE rev IS NOT NULL AND session = (SELECT max(session) FROM rev5 WHERE rev IS NOT NULL)")


@query("TOP-07", "symbol ~rev #rank ~rank_percent #confidence", parts="latest_rev", sql="""
SELECT symbol, rev, rank, rank_percent, round_even(100*rank_percent, 0) AS confidence FROM (
SELECT symbol, rev, row_number() OVER (ORDER BY rev DESC, symbol) AS rank, cume_dist() OVER (ORDER BY rev) AS rank_percent FROM latest_rev) WHERE rank <= 5""")
def latest_signal(spark, sf):
    from ..operators.signals import latest_top

    return latest_top(rev5(spark, sf), "rev", 5)


part("cands", "rev5 cal", """
SELECT symbol || '-' || strftime(session, '%Y%m%d') AS id, symbol, session, CASE WHEN rev >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
 round_even(100*cume_dist() OVER (PARTITION BY session ORDER BY abs(rev)), 0) AS confidence, abs(rev) AS expected
FROM rev5 WHERE rev IS NOT NULL AND session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))""")


def candidates(spark, sf):
    x = X.month_end_rows(rev5(spark, sf).where("rev is not null"), P.calendar(spark, sf))
    return x.select(
        F.concat_ws("-", "symbol", F.date_format("session", "yyyyMMdd")).alias("id"), "symbol", "session",
        F.when(F.col("rev") >= 0, "LONG").otherwise("SHORT").alias("direction"),
        F.bround(F.lit(100.0) * F.cume_dist().over(W.partitionBy("session").orderBy(F.abs("rev"))), 0).alias("confidence"),
        F.abs("rev").alias("expected"))


RANKED = """
SELECT id, session, CASE WHEN confidence >= 60 AND rank <= 5 THEN 'TOP_' || direction ELSE 'SKIPPED' END AS bucket, confidence,
 CASE WHEN confidence >= 60 AND rank <= 5 THEN rank END AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY session, direction, confidence >= 60 ORDER BY confidence DESC, expected DESC, symbol, id) AS rank FROM cands)"""


@query("TOP-08", "id session bucket ~rank #confidence", parts="cands", sql=RANKED)
def ranked_recommendations(spark, sf):
    from ..operators.signals import rank_recommendations

    return rank_recommendations(candidates(spark, sf))


@query("SNK-03", "id session bucket ~rank #confidence", parts="cands", sql=RANKED)
def bucket_file(spark, sf):
    """The ranking as CSV, one folder per bucket, read back with its schema."""
    path, columns = scratch_path(spark, "buckets"), ["id", "session", "rank", "confidence", "bucket"]
    ranked_recommendations(spark, sf).select(columns).write.partitionBy("bucket").option("header", True).csv(path)
    return spark.read.option("header", True).schema("id string, session date, rank double, confidence double, bucket string").csv(path)


@query("TOP-09", "symbol #loss_first #return_first", parts="rets", sql="""
SELECT symbol, row_number() OVER (ORDER BY es DESC, p_loss, worst DESC, mean DESC, symbol) AS loss_first,
 row_number() OVER (ORDER BY mean DESC, es DESC, p_loss, symbol) AS return_first FROM (
SELECT symbol, round(avg(ret) FILTER (ret <= q), 9) AS es, round(avg(CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END), 9) AS p_loss, round(min(ret), 9) AS worst, round(avg(ret), 9) AS mean
FROM (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY symbol) AS q FROM rets WHERE ret IS NOT NULL) GROUP BY symbol HAVING count(*) >= 100)""")
def loss_first_ranking(spark, sf):
    from ..operators.risk import loss_profile
    from ..operators.signals import lexicographic_ranks

    return lexicographic_ranks(loss_profile(P.with_returns(spark, sf), "symbol", "ret", 100))


@query("TOP-10", "symbol kind best worst", parts="rets", sql="""
WITH m AS (SELECT symbol, kind, label, round(avg(ret),9) AS mean FROM (
 SELECT symbol, ret, 'WEEKDAY' AS kind, CAST(isodow(session)-1 AS VARCHAR) AS label FROM rets UNION ALL
 SELECT symbol, ret, 'MONTH', CAST(month(session) AS VARCHAR) FROM rets) WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 30)
SELECT symbol, kind, arg_max(label, (mean, label)) AS best, arg_min(label, (mean, label)) AS worst FROM m GROUP BY symbol, kind""")
def best_and_worst_windows(spark, sf):
    from ..operators.signals import best_worst, window_means

    return best_worst(window_means(P.with_returns(spark, sf), 30))


@query("TOP-11", "symbol label ~mean #rank", parts="rets", sql="""
SELECT symbol, label, mean, row_number() OVER (ORDER BY mean DESC, symbol) AS rank FROM (
SELECT symbol, label, mean FROM (SELECT symbol, CAST(isodow(session)-1 AS VARCHAR) AS label, round(avg(ret),9) AS mean FROM rets WHERE ret IS NOT NULL
 GROUP BY ALL HAVING count(*) >= 30) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, label DESC) = 1)""")
def symbols_by_best_window(spark, sf):
    from ..operators.signals import compare_symbols, window_means

    return compare_symbols(window_means(P.with_returns(spark, sf), 30).where("kind = 'WEEKDAY'"))


@query("TOP-12", "symbol #chosen_rank #n_better better", parts="rets", sql="""
WITH m AS (SELECT symbol, isodow(session)-1 AS d, round(avg(ret),9) AS mean FROM rets WHERE ret IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
 r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY mean DESC) AS k FROM m)
SELECT a.symbol, a.k AS chosen_rank, count(b.d) AS n_better, coalesce(string_agg(CAST(b.d AS VARCHAR), ',' ORDER BY b.k), '') AS better
FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.k < a.k WHERE a.d = 2 GROUP BY a.symbol, a.k""")
def chosen_weekday_review(spark, sf):
    from ..operators.signals import choice_review, window_means

    return choice_review(window_means(P.with_returns(spark, sf), 30).where("kind = 'WEEKDAY'"), "2")


@query("TOP-13", "symbol session", parts="bars cal", sql="""
SELECT symbol, session FROM bars WHERE session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))""")
def month_end_sessions(spark, sf):
    return X.month_end_rows(P.bars(spark, sf), P.calendar(spark, sf))


@query("TOP-06 AGG-11 JOIN-09", "cycle a b ~ssd ~sd #rank", parts="grid", sql="""
SELECT cycle, a, b, ssd, sd, row_number() OVER (PARTITION BY cycle ORDER BY round(ssd,6), a, b) AS rank FROM (
SELECT x.cycle, x.symbol AS a, y.symbol AS b, sum(power(x.v-y.v,2)) AS ssd, stddev_samp(x.v-y.v) AS sd FROM
 (SELECT symbol, year(session) AS cycle, session, px/first_value(px) OVER (PARTITION BY symbol, year(session) ORDER BY session) AS v FROM grid WHERE px IS NOT NULL AND asset_type = 'etf') x
 JOIN (SELECT symbol, year(session) AS cycle, session, px/first_value(px) OVER (PARTITION BY symbol, year(session) ORDER BY session) AS v FROM grid WHERE px IS NOT NULL AND asset_type = 'etf') y
 ON x.session = y.session AND x.symbol < y.symbol GROUP BY ALL HAVING count(*) >= 20) QUALIFY rank <= 3""")
def closest_pairs(spark, sf):
    from ..operators.pairwise import closest

    own = W.partitionBy("symbol", "cycle").orderBy("session")
    x = P.placed(spark, sf).where("asset_type = 'etf'").withColumn("cycle", F.year("session"))
    x = x.withColumn("v", F.col("px") / F.first("px").over(own))
    return closest(x, ["cycle"], "symbol", "session", "v", 3, 20)
