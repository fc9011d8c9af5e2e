"""Composite decision tables."""

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators.advisor import latest
from ..operators.conditions import calendar_conditions, condition_statistics
from ..operators.frames import framed
from ..sources import panel as P
from .catalog import query
from .inference import streams
from .scalars import risk_lanes
from .windows import recursive_indicators


@query("PRT-17", "horizon status #agreeing gates", parts="")
def decision_snapshot(spark, sf):
    """Agreement of the ETF proxies on trend, with the gates that every horizon must pass."""
    x = latest(P.with_returns(spark, sf).where("asset_type = 'etf'").select("symbol", "session", "px", framed(F.avg("px"), "px", 20, minimum=10).alias("m"), "available_at"))
    s = x.agg(F.count_if(F.col("px") > F.col("m")).alias("up"), F.count("*").alias("n"), F.max("available_at").alias("seen"))
    ready = risk_lanes(spark, sf).agg(F.count_if(F.col("status") == "READY").alias("ready"))
    s = s.join(ready).select("up", "n", "ready", F.explode(F.array(*[F.lit(h) for h in ("1D", "3D", "5D", "10D")])).alias("horizon"))
    from ..operators.filters import reasons

    g = reasons(NO_LANE=F.col("ready") == 0, TOO_FEW_PROXIES=F.col("n") < 4, DISAGREEMENT=(F.col("up") > 0) & (F.col("up") < F.col("n")))
    return s.select("horizon", F.greatest("up", F.col("n") - F.col("up")).alias("agreeing"), F.array_join(g, ",").alias("gates"),
                    F.when(F.size(g) > 0, "STAND_ASIDE").when(F.col("up") > 0, "LONG").otherwise("SHORT").alias("status"))


@query("PRT-25", "symbol condition #n ~mean ~t ~p_bonf tier", digits=5)
def instrument_advisor(spark, sf):
    """Single conditions and all pairs of conditions of different kinds, Bonferroni per symbol."""
    c = calendar_conditions(P.calendar_table(spark, sf)).withColumn("kind", F.split("condition", "_")[0])
    other = c.select("pos", F.col("condition").alias("c2"), F.col("kind").alias("k2"))
    pairs = c.join(other, "pos").where("kind < k2 and kind <> 'ALL' and k2 <> 'ALL'").select("session", "pos", F.concat_ws("&", "condition", "c2").alias("condition"))
    x = condition_statistics(P.with_returns(spark, sf), c.select("session", "pos", "condition").unionByName(pairs), 60)
    p = I.with_p(x)
    size = p.groupBy("symbol").agg(F.count("*").alias("family"))
    return p.join(size, "symbol").withColumn("p_bonf", F.least(F.lit(1.0), F.col("p") * F.col("family")))


@query("ASM-11", "trial window #n ~mean ~sharpe ~hit_rate", digits=5, parts="streams", sql="""
SELECT trial, CASE WHEN session < DATE '2001-01-01' THEN 'PRE' ELSE 'SEALED' END AS "window", count(*) AS n, avg(net) AS mean, CASE WHEN stddev_samp(net) > 0 THEN avg(net)/stddev_samp(net)*sqrt(252.0) END AS sharpe, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM streams GROUP BY ALL""")
def before_and_sealed_window(spark, sf):
    s = streams(spark, sf).withColumn("window", F.when(F.col("session") < F.lit("2001-01-01").cast("date"), "PRE").otherwise("SEALED"))
    return I.summarize(s, ["trial", "window"], "net")


@query("WIN-51 WIN-21", "symbol ~rsi2", digits=5, parts="ewm", sql="""
SELECT symbol, CASE WHEN i >= 3 THEN CASE WHEN d2 = 0 AND u2 > 0 THEN 100.0 WHEN d2 = 0 THEN 50.0 ELSE 100.0-100.0/(1.0+u2/d2) END END AS rsi2 FROM ewm QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1""")
def latest_rsi(spark, sf):
    return latest(recursive_indicators(spark, sf))
