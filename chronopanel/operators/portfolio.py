"""Weights to portfolio streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold


def overlapping_cohorts(x: DataFrame, entry: str, holding: int, out: str, key: str = "symbol") -> DataFrame:
    """Mean of the last ``holding`` entry rows of a dense panel (shorter at the start)."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(1 - holding, 0)
    return x.withColumn(out, F.avg(F.coalesce(F.col(entry), F.lit(0.0))).over(w))


def month_start_hold(x: DataFrame, weight: str, out: str, key: str = "symbol") -> DataFrame:
    """Weight of the month's first session, held through the month."""
    first = F.row_number().over(W.partitionBy(key, F.trunc("session", "MM")).orderBy("pos")) == 1
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_w", F.when(first, F.col(weight)))
    return x.withColumn(out, F.coalesce(F.last("_w", True).over(w), F.lit(0.0))).drop("_w")


def month_end_decisions(x: DataFrame, decision: str, out: str, key: str = "symbol") -> DataFrame:
    """Decision of each month's last session, in force from the next session."""
    last = F.row_number().over(W.partitionBy(key, F.trunc("session", "MM")).orderBy(F.col("pos").desc())) == 1
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_w", F.when(last, F.col(decision)))
    return x.withColumn(out, F.coalesce(F.last("_w", True).over(w), F.lit(0.0))).drop("_w")


def lagged_book(weights: DataFrame, market: DataFrame, lag: int, key: str | None = None) -> DataFrame:
    """Gross return per session of weights applied ``lag`` sessions later (missing returns count as zero,
    a session without any return is null)."""
    keys = [key] if key else []
    w = weights.where("weight <> 0").select(*keys, "symbol", (F.col("pos") + lag).alias("pos"), "weight")
    x = w.join(market.select("symbol", "pos", "session", "ret"), ["symbol", "pos"])
    return x.groupBy(*keys, "pos", "session").agg(
        F.when(F.count("ret") > 0, F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0)))).alias("gross"))


def mask_stream(x: DataFrame, flag: str, ret: str, side_cost: float, keys=("symbol",)) -> DataFrame:
    """Return on flagged sessions, paying one side on the first and one on the last session of a run."""
    w = Window.partitionBy(*keys).orderBy("pos")
    f = F.col(flag)
    no = F.lit(False)
    first = f & ~F.coalesce(F.lag(f).over(w), no)
    last = f & ~F.coalesce(F.lead(f).over(w), no)
    cost = (first.cast("double") + last.cast("double")) * side_cost
    return x.select(*keys, "session", "pos", F.when(f, F.coalesce(ret, F.lit(0.0))).otherwise(0.0).alias("gross"), cost.alias("cost")).withColumn(
        "net", F.col("gross") - F.col("cost"))


def flip_stream(x: DataFrame, position: str, ret: str, side_cost: float, keys=("symbol",)) -> DataFrame:
    """Held position times return, paying for every change of position."""
    w = Window.partitionBy(*keys).orderBy("pos")
    p = F.col(position)
    cost = F.abs(p - F.coalesce(F.lag(p).over(w), F.lit(0.0))) * side_cost
    return x.select(*keys, "session", "pos", (p * F.coalesce(ret, F.lit(0.0))).alias("gross"), cost.alias("cost")).withColumn("net", F.col("gross") - F.col("cost"))


def fill_limited(rows: DataFrame, gross_cap: float) -> DataFrame:
    """Positions when a name that cannot trade keeps its position.

    A trial's book is one vector over the names it ever wants, and a session's orders are the same vector. What was
    closed to trading on the session before is carried; the rest shares the gross that the carried part leaves.
    """
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    orders = rows.groupBy("trial", "pos").agg(F.array_sort(F.collect_list(F.struct("symbol", F.col("desired").cast("double").alias("desired"), "tradable"))).alias("orders"))

    def step(s, row):
        wanted = F.transform(row["orders"], lambda o: o["desired"])
        free = F.when(F.size(s["closed"]) == 0, F.transform(wanted, lambda _: F.lit(0.0))).otherwise(F.zip_with(s["closed"], wanted, lambda c, w: F.when(c, 0.0).otherwise(w)))
        carried = F.zip_with(s["book"], s["closed"], lambda b, c: F.when(c, b).otherwise(0.0))
        share = F.least(F.lit(1.0), F.greatest(gross_cap - size(carried), F.lit(0.0)) / F.nullif(size(free), F.lit(0.0)))
        book = F.zip_with(carried, free, lambda k, f: F.coalesce(k, F.lit(0.0)) + f * F.coalesce(share, F.lit(1.0)))
        return {"book": book, "closed": F.transform(row["orders"], lambda o: ~o["tradable"])}

    none = {"book": F.array().cast("array<double>"), "closed": F.array().cast("array<boolean>")}
    named = lambda _, s, row: {"book": F.arrays_zip(F.transform(row["orders"], lambda o: o["symbol"]).alias("symbol"), s["book"].alias("weight"))}
    held = fold(orders, ["trial"], "pos", ["orders"], none, step, named, "book:array<struct<symbol:string,weight:double>>")
    return held.select("trial", "pos", F.inline("book")).where("weight <> 0").select("trial", "symbol", "pos", "weight")


def trade_pairs(days: DataFrame, threshold: float, leg_weight: float, daily_borrow: float) -> DataFrame:
    """Open at ``threshold`` sigma, close at the zero cross, both one session later; closed by cycle end.

    The position of a session is decided by the session before: `plan` is the side to hold next, and legs are paid
    whenever the side changes, or on the last day of the cycle if one is still held.
    """
    ends = Window.partitionBy("cycle", "a", "b")
    x = days.withColumn("last", F.col("pos") == F.max("pos").over(ends))

    def step(s, row):
        wide = (row["sigma"] > 0) & (F.abs(row["spread"]) > threshold * row["sigma"])
        opened = F.when(wide, -F.signum(row["spread"])).otherwise(0.0)
        after = F.when(s["plan"] == 0, opened).otherwise(F.when(s["plan"] * row["spread"] >= 0, 0.0).otherwise(s["plan"]))
        return {"side": s["plan"], "plan": F.when(row["last"], 0.0).otherwise(after)}

    def emit(before, now, row):
        # the side of the day before earns the day's return; the change of side is paid at its end
        side = before["side"]
        legs = (before["plan"] != side).cast("double") + (row["last"] & (before["plan"] != 0)).cast("double")
        gross = side * (row["ret_a"] - row["ret_b"]) * leg_weight
        return {"gross": gross, "cost": F.abs(side) * daily_borrow * leg_weight + legs * row["leg_cost"], "active": side != 0}

    start = {"side": F.lit(0.0), "plan": F.lit(0.0)}
    return fold(x, ["cycle", "a", "b"], "pos", ["spread", "sigma", "ret_a", "ret_b", "leg_cost", "last"], start, step, emit, "gross:double,cost:double,active:boolean")
