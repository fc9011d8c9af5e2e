"""Monthly rebalanced studies: selections, drifted weights and per-name change costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.costs import flip_fraction
from .asof import asof_join


def numbered_month_ends(cal: DataFrame) -> DataFrame:
    """(k, session, pos, next_pos): one row per month."""
    m = cal.groupBy(F.trunc("session", "MM").alias("m")).agg(F.max("session").alias("session"), F.max("pos").alias("pos"))
    one = W.partitionBy(F.lit(1)).orderBy("session")
    return m.select(F.row_number().over(one).alias("k"), "session", "pos", F.lead("pos").over(one).alias("next_pos"))


def first_usable(events: DataFrame, day: str, cal: DataFrame) -> DataFrame:
    """Events with `first`, the position of the first session after the day on which they became known."""
    key = F.lit(1).alias("_k")
    sessions = cal.select(key, F.col("pos").alias("first"), F.col("session").cast("timestamp").alias("_at"))
    asked = events.select("*", key, F.col(day).cast("timestamp").alias("_day"))
    found = asof_join(asked, sessions, ["_k"], "_day", "_at", ["first"], "forward", True, bucket_seconds=86400 * 31)
    return found.where("first is not null").drop("_k", "_day", "matched_at")


def fresh_at(events: DataFrame, ends: DataFrame, value: str, order: str, stale: int) -> DataFrame:
    """(symbol, session, value): at each month end the newest value of a symbol that is at most ``stale`` sessions old."""
    ranked = F.struct("first", F.col(order).alias("_o"))
    x = events.select("symbol", value, ranked.alias("_r"), F.explode(F.sequence(F.col("first"), F.col("first") + stale - 1)).alias("pos"))
    return x.join(ends.select("pos", "session"), "pos").groupBy("symbol", "session").agg(F.max_by(value, "_r").alias(value))


def selection_changes(selected: DataFrame, ends: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Entering and leaving names between consecutive selections (of each study in ``by``)."""
    s = selected.join(ends.select("k", "session"), "session").select(*by, "k", "symbol", "names")
    before = s.select(*by, (F.col("k") + 1).alias("k"), "symbol", F.col("names").alias("names_before"))
    x = s.join(before, [*by, "k", "symbol"], "full").where("names is null or names_before is null")
    x = x.join(ends.select("k", "session"), "k")
    return x.select(*by, "symbol", "k", "session", F.when(F.col("names").isNotNull(), "ENTER").otherwise("LEAVE").alias("change"),
                    F.coalesce("names", "names_before").alias("names"))


def drifted_returns(selected: DataFrame, ends: DataFrame, market: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily gross return of equal-weight buy-and-hold between rebalances.

    Selected names are expanded to their window's sessions; missing returns count as zero, so the running
    product runs over the window's own positions.
    """
    s = selected.select(*by, "symbol", "session").join(ends.where("next_pos is not null"), "session")
    x = s.select(*by, "k", "symbol", F.explode(F.sequence(F.col("pos") + 1, F.col("next_pos"))).alias("pos"))
    x = x.join(market.select("symbol", "pos", "ret"), ["symbol", "pos"], "left").withColumn("r", F.coalesce("ret", F.lit(0.0)))
    w = W.partitionBy(*by, "k", "symbol").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("drift", F.coalesce(F.product(F.col("r") + 1).over(w), F.lit(1.0)))
    return x.groupBy(*by, "pos").agg((F.sum(F.col("drift") * F.col("r")) / F.sum("drift")).alias("gross"))


def change_costs(changes: DataFrame, ends: DataFrame, market: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    x = changes.join(ends.select("k", "pos"), "k").join(market.select("symbol", "pos", "adv20"), ["symbol", "pos"], "left")
    cost = flip_fraction(F.lit(1.0) / F.greatest("names", F.lit(1)), F.coalesce("adv20", F.lit(1e8)), F.lit("equity"))
    return x.groupBy(*by, "pos").agg(F.sum(cost).alias("cost"))


def study(selected: DataFrame, ends: DataFrame, market: DataFrame, cal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Gross, cost and net per session of every study in ``by``; net exists where there is a gross return or a cost."""
    ch = change_costs(selection_changes(selected, ends, by), ends, market, by)
    x = drifted_returns(selected, ends, market, by).join(ch, [*by, "pos"], "full").join(cal, "pos").where("gross is not null or cost > 0")
    zero = F.lit(0.0)
    return x.select(*by, "session", "pos", "gross", F.coalesce("cost", zero).alias("cost"), (F.coalesce("gross", zero) - F.coalesce("cost", zero)).alias("net"))
