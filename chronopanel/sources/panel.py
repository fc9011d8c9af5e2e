"""Stage tables: the daily bar panel and its calendar, derived from the order-line tables.

The panel is the only step that touches the full line table. It is one scan of six columns, one
equi join and one aggregate with fixed-width buffers, so map-side combining shrinks every task's
output to at most (symbols x sessions) rows before the shuffle. Everything downstream works on that
calendar-bounded table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..session import scratch_path

SPLIT_DAY = dt.date(1998, 6, 1)
_KEPT: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage table: written once per application to the shared folder and read back.

    A written table ends the plan's lineage, survives the loss of any executor, and lets later readers
    prune columns and push filters; a cache would do none of the three.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _KEPT[key] = spark.read.parquet(path)
    return _KEPT[key]


def price_cents(extended: Column, quantity: Column) -> Column:
    """Damped unit price in whole cents (daily moves stay above -100 %)."""
    return F.round(F.lit(10000.0) * F.pow(extended / quantity / F.lit(1000.0), F.lit(0.05))).cast("bigint")


def build_bars(lines: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Order lines to daily bars. First and last trade travel inside one packed bigint, so open and
    close are plain min/max and the aggregate stays in hash-aggregate code generation."""
    ticks = lines.where((F.col("l_quantity") > 0) & (F.weekday("l_shipdate") < 5)).select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("session"),
        "l_quantity",
        price_cents(F.col("l_extendedprice"), F.col("l_quantity")).alias("cents"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tick"),
    )
    # Keys and buffers are fixed-width until the rows are daily; names join in afterwards. A string buffer
    # here would turn both aggregates into sorts of the whole line table.
    joined = ticks.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    packed = F.col("tick") * 100000 + F.col("cents")
    daily = joined.groupBy("s_nationkey", "session").agg(
        F.min(packed).alias("first_packed"),
        F.max(packed).alias("last_packed"),
        F.max("cents").alias("hi"),
        F.min("cents").alias("lo"),
        F.sum("l_quantity").alias("volume"),
    )
    names = nation.select("n_nationkey", F.col("n_name").alias("symbol"), F.col("n_regionkey").alias("region"))
    daily = daily.join(names, F.col("s_nationkey") == F.col("n_nationkey"))
    splits = F.col("n_nationkey") % 5 == 0
    mult = F.when(splits & (F.col("session") < F.lit(SPLIT_DAY)), 2.0).otherwise(1.0)
    last = (F.col("last_packed") % 100000) / 100.0
    return daily.select(
        "symbol",
        F.lit("XNYS").alias("exchange"),
        F.when(F.col("n_nationkey") % 7 == 0, "etf").otherwise("equity").alias("asset_type"),
        F.concat(F.lit("S"), F.col("region").cast("string")).alias("sector"),
        "session",
        clock.market_close("session").alias("event_time"),
        clock.bar_available("session").alias("available_at"),
        ((F.col("first_packed") % 100000) / 100.0 * mult).alias("open"),
        (F.col("hi") / 100.0 * mult).alias("high"),
        (F.col("lo") / 100.0 * mult).alias("low"),
        (last * mult).alias("close"),
        "volume",
        last.alias("adjusted_close"),
        F.when((F.dayofmonth("session") == 15) & (F.month("session") % 3 == 0), 0.25).otherwise(0.0).alias("dividend"),
        F.when(splits & (F.col("session") == F.lit(SPLIT_DAY)), 2.0).otherwise(1.0).alias("split_factor"),
        F.lit("lines").alias("source"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return build_bars(*[table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation")])

    return kept(spark, sf_dir, "bars", build)


def second_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same panel from even line numbers only: an independent, thinner record of the same market."""

    def build():
        lines = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") % 2 == 0)
        return build_bars(lines, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))

    return kept(spark, sf_dir, "bars_b", build)


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Calendar of observed sessions with a dense position. One row per trading day, so the single
    ordered window holds a few thousand rows however large the panel is."""
    return sessions.select("session").distinct().select(
        "session", F.row_number().over(W.orderBy("session")).alias("pos")
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "cal", lambda: number_sessions(bars(spark, sf_dir)))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their calendar position; ``px`` is the adjusted close."""

    def build():
        b = bars(spark, sf_dir).join(calendar(spark, sf_dir), "session")
        ratio = F.col("adjusted_close") / F.col("close")
        return b.select(
            "*",
            F.col("adjusted_close").alias("px"),
            (ratio * F.col("open")).alias("open_adj"),
            (ratio * F.col("high")).alias("high_adj"),
            (ratio * F.col("low")).alias("low_adj"),
        )

    return kept(spark, sf_dir, "placed", build)


def returns_of(p: DataFrame) -> DataFrame:
    """Placed bars plus the one-session adjusted return (null when the previous session has no bar)."""
    from ..operators.frames import shifted

    p = p.withColumn("px1", shifted("px", 1)).withColumn("close1", shifted("close", 1))
    return p.withColumn("ret", F.col("px") / F.col("px1") - 1.0)


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "rets", lambda: returns_of(placed(spark, sf_dir)))


def dense(df: DataFrame, cal: DataFrame, keys=("symbol", "sector", "asset_type")) -> DataFrame:
    """Every key on every session. The calendar travels as one array in one row."""
    span = cal.agg(F.array_sort(F.collect_list(F.struct("pos", "session"))).alias("days"))
    names = df.select(*keys).distinct()
    filled = names.join(F.broadcast(span)).select(*keys, F.explode("days").alias("d")).select(
        *keys, F.col("d.pos").alias("pos"), F.col("d.session").alias("session")
    )
    rest = [c for c in df.columns if c not in (*keys, "pos", "session")]
    return filled.join(df.select(keys[0], "pos", *rest), [keys[0], "pos"], "left")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(
        spark, sf_dir, "grid", lambda: dense(with_returns(spark, sf_dir), calendar(spark, sf_dir))
    )


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled-event stand-in: days of very large urgent orders (at most one row per day)."""
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 490000)).select(
        F.to_date("o_orderdate").alias("event_day")
    ).distinct()


def calendar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.calendar import calendar_features, closures

    def build():
        cal = calendar(spark, sf_dir)
        return calendar_features(cal, closures(cal), event_days(spark, sf_dir))

    return kept(spark, sf_dir, "flags", build)


def venue_calendar(spark: SparkSession, sf_dir: str, symbol: str = "NATION_1") -> DataFrame:
    """Sessions on which one thin symbol traded: a calendar with irregular closures."""
    return kept(
        spark, sf_dir, f"venue-{symbol}",
        lambda: number_sessions(bars(spark, sf_dir).where(F.col("symbol") == symbol)),
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate-event stand-in from large orders: (symbol, event_day, kind, value, available_at)."""
    def build():
        o = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 440000)
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("symbol"))
        x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        p = F.substring("o_orderpriority", 1, 1)
        kind = F.when(p == "1", "EARNINGS").when(p == "2", "GUIDANCE_NEGATIVE").when(p == "3", "HALT").otherwise("OTHER")
        return x.select(
            F.col("o_orderkey").alias("event_id"), "symbol", F.to_date("o_orderdate").alias("event_day"),
            kind.alias("kind"), F.col("o_totalprice").alias("value"),
            F.date_add(F.to_date("o_orderdate"), 1).alias("available_day"),
            F.when(p == "3", F.date_add(F.to_date("o_orderdate"), 3)).alias("ended_day"),
        )

    return kept(spark, sf_dir, "announcements", build)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open membership intervals: two per symbol, the second open-ended for some."""
    b = bars(spark, sf_dir)
    k = F.expr("cast(substring(symbol, 8) as int)")
    span = b.groupBy("symbol").agg(F.min("session").alias("first")).withColumn("k", k)
    start = F.date_add("first", F.col("k") * 20)
    first_end = F.date_add(start, F.lit(700) + F.col("k") * 13)
    second = F.date_add(first_end, 100)
    end = F.when(F.col("k") % 3 != 0, F.date_add(second, 900))
    return span.select("symbol", F.inline(F.array(
        F.struct(start.alias("start"), first_end.alias("end")), F.struct(second.alias("start"), end.alias("end")))))
