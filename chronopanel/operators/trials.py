"""Declared hypotheses as tables: predicate grids, controls, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Predicate families and their levels.
LEVELS = {
    "weekday": ("0", "1", "2", "3", "4"),
    "month": tuple(str(m) for m in range(1, 13)),
    "turn_of_month": ("TOM", "REST"),
    "holiday": ("PRE", "POST"),
    "event": ("DAY_BEFORE", "DAY_OF", "EVENT_WEEK"),
    "opex": ("WEEK",),
    "month_end": ("WINDOW", "REST"),
    "quarter_end": ("WINDOW", "REST"),
}
SESSIONS = ("CLOSE_TO_CLOSE", "OVERNIGHT", "INTRADAY")
HOLDINGS = (1, 3, 5, 21)  # of close-to-close trials; the other legs last one session
DIRECTIONS = ("LONG", "SHORT")


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, v) for f, vs in LEVELS.items() for v in vs], "family string, value string")


def predicate_table(spark: SparkSession) -> DataFrame:
    """Single predicates and pairs from two different families, one row per (hypothesis, predicate)."""
    one = levels(spark)
    label = F.concat_ws("=", "family", "value")
    single = one.select(label.alias("hypothesis"), "family", "value", F.lit(1).alias("n_predicates"))
    a, b = one.alias("a"), one.alias("b")
    pair = a.join(b, F.col("a.family") < F.col("b.family")).select(
        F.concat_ws("&", F.concat_ws("=", "a.family", "a.value"), F.concat_ws("=", "b.family", "b.value")).alias("hypothesis"),
        F.inline(F.array(F.struct(F.col("a.family").alias("family"), F.col("a.value").alias("value")),
                         F.struct(F.col("b.family").alias("family"), F.col("b.value").alias("value")))),
    ).withColumn("n_predicates", F.lit(2))
    return single.unionByName(pair)


def calendar_predicates(flags: DataFrame) -> DataFrame:
    """Calendar flags as (session, family, value) rows."""
    c = F.col

    def on(family, value, test):
        return F.when(test, F.struct(F.lit(family).alias("family"), F.lit(value).alias("value")))

    def either(family, flag, yes, no):
        return F.struct(F.lit(family).alias("family"), F.when(c(flag), yes).otherwise(no).alias("value"))

    rows = F.array_compact(F.array(
        F.struct(F.lit("weekday").alias("family"), c("weekday").cast("string").alias("value")),
        F.struct(F.lit("month").alias("family"), c("month").cast("string").alias("value")),
        either("turn_of_month", "turn_of_month", "TOM", "REST"),
        on("holiday", "PRE", c("pre_holiday")), on("holiday", "POST", c("post_holiday")),
        on("event", "DAY_BEFORE", c("event_day_before")), on("event", "DAY_OF", c("event_day_of")), on("event", "EVENT_WEEK", c("event_week")),
        on("opex", "WEEK", c("opex_week")),
        either("month_end", "month_end_window", "WINDOW", "REST"), either("quarter_end", "quarter_end_window", "WINDOW", "REST"),
    ))
    return flags.select("session", "pos", F.inline(rows))


def predicate_sessions(predicates: DataFrame, rows: DataFrame) -> DataFrame:
    """Sessions on which all predicates of a hypothesis hold."""
    hit = F.broadcast(predicates).join(rows, ["family", "value"])  # the grid is a constant of this module
    return hit.groupBy("hypothesis", "session", "pos").agg(F.count("*").alias("n"), F.first("n_predicates").alias("k")).where(
        "n = k").select("hypothesis", "session", "pos")


def identity(payload: Column, family: Column) -> Column:
    """Family-prefixed 16-hex identity of a canonical JSON payload (struct fields in sorted order)."""
    return F.concat_ws("-", family, F.substring(F.sha2(F.to_json(payload), 256), 1, 16))


def seed_of(*parts: Column) -> Column:
    """Stable unsigned 64-bit seed of a key: the first eight bytes of its SHA-256, the lowest first."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    lowest_first = F.concat(*[F.substring(digest, k, 2) for k in range(15, 0, -2)])
    return F.conv(lowest_first, 16, 10).cast("decimal(20,0)")


def with_controls(trials: DataFrame, key: str = "trial", campaign: int = 0) -> DataFrame:
    """Each real trial followed by its two placebos (date shuffle, label permutation)."""
    kinds = F.array(F.lit("REAL"), F.lit("SHUFFLED_DATES"), F.lit("MATCHED_RANDOM"))
    x = trials.select("*", F.explode(kinds).alias("kind"))
    child = F.when(F.col("kind") == "REAL", F.col(key)).otherwise(F.concat_ws("|", key, "kind"))
    return x.select(
        child.alias("spec"), F.col(key).alias("parent"), "kind", *[c for c in trials.columns if c != key],
        F.when(F.col("kind") != "REAL", seed_of(F.lit(str(campaign)), F.col(key), F.col("kind"))).alias("seed"))


def shapes(*extra: Column) -> Column:
    """Array of the (leg, holding) pairs of a trial, with further fields if any."""
    return F.array(*[
        F.struct(F.lit(s).alias("leg"), F.lit(h).alias("holding"), *extra)
        for s in SESSIONS for h in (HOLDINGS if s == "CLOSE_TO_CLOSE" else (1,))])


def hypothesis_grid(spark: SparkSession, sectors: DataFrame | None = None) -> DataFrame:
    """Every declared calendar hypothesis: no predicate, one, or two of different families (``sectors`` with a column
    `sector` adds a family of their names), for each leg, holding and direction."""
    grid = predicate_table(spark)
    if sectors is not None:
        names = sectors.select(F.lit("sector").alias("family"), F.col("sector").alias("value")).distinct()
        own = F.struct("family", "value")
        alone = names.select(F.concat_ws("=", "family", "value").alias("hypothesis"), "family", "value", F.lit(1).alias("n_predicates"))
        with_one = levels(spark).select(own.alias("x")).join(names.select(own.alias("y"))).select(
            F.concat_ws("&", F.array_sort(F.array(F.concat_ws("=", "x.family", "x.value"), F.concat_ws("=", "y.family", "y.value")))).alias("hypothesis"), F.inline(F.array("x", "y"))).withColumn("n_predicates", F.lit(2))
        grid = grid.unionByName(alone).unionByName(with_one)
    predicates = grid.groupBy("hypothesis").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "value")))).alias("predicates"))
    free = spark.range(1).select(F.lit("ANY").alias("hypothesis"), F.create_map().cast("map<string,string>").alias("predicates"))
    x = predicates.unionByName(free).select("hypothesis", "predicates", F.inline(shapes())).withColumn("direction", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])))
    return x.withColumn("trial", F.concat_ws("|", "hypothesis", "leg", F.col("holding").cast("string"), "direction"))
