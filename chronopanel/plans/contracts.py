"""User-supplied features, stream builders and sources."""

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import features as FE
from ..operators import inference as I
from ..operators import monthly as MO
from ..operators import crosssec as X
from ..session import scratch_path
from ..sources import contracts as SC
from ..sources import panel as P
from ..sources.ticks import ticks
from .catalog import query
from .inference import market
from .oracle_parts import part

part("tick_seconds", "", "SELECT event_type AS symbol, date_trunc('second', ts) AS second, count(*) AS n FROM events GROUP BY ALL")


@query("UDF-01", "symbol session ~price_level ~two_day", parts="grid", sql="SELECT symbol, session, px/100 AS price_level, px/lag(px,2) OVER (PARTITION BY symbol ORDER BY pos)-1 AS two_day FROM grid QUALIFY px IS NOT NULL")
def user_features(spark, sf):
    registry = C.FeatureRegistry()
    registry.add("price_level", needs=("px",), lookback=0, build=lambda d: d.withColumn("price_level", F.col("px") / 100))
    registry.add("two_day", needs=("px",), lookback=2, build=lambda d: d.withColumn("two_day", -FE.reversal(2)))
    return registry.apply(P.placed(spark, sf), ["price_level", "two_day"])


@query("UDF-03", "study #n ~mean ~t", digits=5)
def user_stream_study(spark, sf):
    cal, m = P.calendar(spark, sf), market(spark, sf)
    builders = {
        "low_price": lambda d: d.withColumn("feature", -F.col("px")),
        "five_day": lambda d: d.withColumn("feature", FE.reversal(5)),
    }
    out = None
    for name, build in builders.items():
        s = MO.study(X.top_fraction(X.month_end_rows(build(m), cal), "feature", 5, 2, False), MO.numbered_month_ends(cal), m, cal).withColumn("study", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return I.hac(out, ["study"], "pos", "net")


@query("UDF-05", "symbol session ~close ~volume", parts="bars", sql="SELECT symbol, session, close, volume FROM bars")
def landed_bar_source(spark, sf):
    path = scratch_path(spark, "landed")
    SC.land(P.bars(spark, sf), SC.CONTRACTS["bars"], path)
    return SC.read(spark, SC.CONTRACTS["bars"], path)


def landed_records(spark, sf):
    """The records of each contract, from the tables that hold them."""
    a, day = P.announcements(spark, sf), lambda c: F.col(c).cast("timestamp")
    t = ticks(spark, sf)
    return {
        "bars": P.bars(spark, sf),
        "events": a.select("event_id", "symbol", "kind", "event_day", day("available_day").alias("available_at")),
        "universe": P.memberships(spark, sf).select("symbol", "start", "end", day("start").alias("available_at")),
        "quotes": t.groupBy("symbol", F.date_trunc("second", "ts").alias("quoted_at")).agg(F.max("price").alias("price")).withColumn("received_at", F.col("quoted_at") + F.expr("INTERVAL 2 SECONDS")),
        "intraday": t.groupBy("symbol", F.lit("TRADE").alias("kind"), F.date_trunc("second", "ts").alias("event_time")).agg(F.max("price").alias("price"), F.sum("size").alias("size")).withColumn("available_at", F.col("event_time")),
    }


@query("UDF-05", "contract rule #n", parts="bars anns members tick_seconds", sql="""
WITH n AS (SELECT 'bars' AS contract, count(*) AS n FROM bars UNION ALL SELECT 'events', count(*) FROM anns UNION ALL SELECT 'universe', count(*) FROM members UNION ALL SELECT 'quotes', count(*) FROM tick_seconds UNION ALL SELECT 'intraday', count(*) FROM tick_seconds)
SELECT contract, rule, CASE WHEN rule = 'ROWS' THEN n ELSE 0 END AS n FROM n CROSS JOIN (VALUES ('ROWS'),('MISSING_VALUE'),('REPEATED_KEY'),('KNOWN_BEFORE_EVENT')) r(rule)""")
def source_contracts(spark, sf):
    """Every contract landed as files, read back by the data source, and held against its rules."""
    out = None
    for name, rows in landed_records(spark, sf).items():
        path = scratch_path(spark, f"landed-{name}")
        SC.land(rows, SC.CONTRACTS[name], path)
        found = SC.violations(SC.read(spark, SC.CONTRACTS[name], path), SC.CONTRACTS[name]).withColumn("contract", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out
