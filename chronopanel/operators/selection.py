"""Exact quantiles of large groups by refined histograms.

A group is counted in intervals between its ends; only the intervals that hold a wanted place are counted again, between
their own ends, until an interval has few rows or one value. Then its distinct values are counted. A task
holds the counts of one interval, never the values of a group, and a value that a third of all rows have is one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS, FEW = 4096, 100_000


def _holding(sizes: DataFrame, targets: DataFrame, group: list[str], carry: list[str]) -> DataFrame:
    """Targets with the `carry` columns of the entry of `sizes` (group, start) that covers their place `k`."""
    entry = F.struct(*carry)
    a = sizes.select(*group, F.col("start").alias("_at"), F.lit(0).alias("_kind"), entry.alias("_entry"))
    b = targets.select(*group, F.col("k").alias("_at"), F.lit(1).alias("_kind"), F.struct("p", "end", "k").alias("_ask"))
    order = W.partitionBy(*group).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    met = a.unionByName(b, allowMissingColumns=True).withColumn("_entry", F.last("_entry", True).over(order)).where("_kind = 1")
    return met.select(*group, "_ask.*", "_entry.*")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """(keys, p, quantile), linear between neighbours; nulls and NaN take no part."""
    rows = df.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)").withColumn("node", F.lit(""))
    whole = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")))
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ends = [F.struct(F.lit(float(p)).alias("p"), F.lit(e).alias("end"), F.least(F.floor(place(p)) + e, F.col("n") - 1).alias("k")) for p in probabilities for e in (0, 1)]
    targets = whole.select(*keys, F.lit("").alias("node"), F.inline(F.array(*ends)))
    live = whole.select(*keys, F.lit("").alias("node"), F.lit(0).cast("bigint").alias("start"), "low", "high")
    group, scale = [*keys, "node"], F.asinh  # the first cells grow with the size of their values, later ones are equal
    while True:
        # few rows: an interval for each key and wanted place at most
        part = scale(F.col("high")) - scale(F.col("low"))
        cell = F.when(part > 0, F.least(F.floor((scale(F.col("x")) - scale(F.col("low"))) / part * cells), F.lit(cells - 1))).otherwise(0)
        rows = rows.join(live, group).select(*keys, "x", "node", "start", cell.alias("cell"))
        counted = rows.groupBy(*group, "start", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = counted.select(*group, "cell", "n", "low", "high", (F.col("start") + before).alias("start"))
        found = cut_lineage(_holding(sizes, targets, group, ["cell", "n", "low", "high", "start"]))
        path = F.concat_ws(".", "node", F.col("cell").cast("string"))
        rows = rows.select(*keys, "x", path.alias("node"))
        targets = found.select(*keys, path.alias("node"), "p", "end", "k")
        live = found.select(*keys, path.alias("node"), "start", "low", "high", "n").distinct()
        if live.where((F.col("high") > F.col("low")) & (F.col("n") > few)).limit(1).count() == 0:
            break
        live = live.drop("n")
        rows, scale = cut_lineage(rows.join(live.select(*group), group, "left_semi")), lambda c: c
    values = rows.join(live.select(*group, "start"), group).groupBy(*group, "start", "x").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = _holding(values.select(*group, "x", (F.col("start") + before).alias("start")), targets, group, ["x"])
    low, high = (F.max(F.when(F.col("end") == e, F.col("x"))) for e in (0, 1))
    y = named.groupBy(*keys, "p").agg(low.alias("_a"), high.alias("_b")).join(whole.select(*keys, "n"), keys)
    at = (F.col("n") - 1) * F.col("p")
    return y.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (at - F.floor(at))).alias("quantile"))
