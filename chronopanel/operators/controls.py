"""Every trial with its two declared controls, evaluated in one job.

SHUFFLED_DATES keeps a trial's positions and gives each date the returns of another one, for all symbols at once.
MATCHED_RANDOM keeps dates and returns and exchanges the symbols of the positions by one permutation, which leaves
exposure and turnover of every date as they are. Permutations are tables ordered by a hash of the control's seed: the
one of dates has a row for each control and session, the one of labels a row for each control and symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import streams as S
from .trials import with_controls

SHUFFLED, MATCHED = "SHUFFLED_DATES", "MATCHED_RANDOM"


def _drawn(item: Column) -> Column:
    return F.md5(F.concat_ws(":", F.col("seed").cast("string"), item.cast("string")))


def date_permutations(controls: DataFrame, cal: DataFrame) -> DataFrame:
    """(spec, parent, pos, from_pos); positions of the calendar have no gaps, so the k-th drawn date stands at k."""
    days = cal.agg(F.collect_list(F.struct("pos", "session")).alias("days"))
    x = controls.where(F.col("kind") == SHUFFLED).join(F.broadcast(days)).select("spec", "parent", "seed", F.inline("days"))
    k = F.row_number().over(W.partitionBy("spec").orderBy(_drawn(F.col("session")), "pos"))
    return x.select("spec", "parent", k.alias("pos"), F.col("pos").alias("from_pos"))


def label_permutations(controls: DataFrame, names: DataFrame) -> DataFrame:
    """(spec, parent, symbol, from_symbol): the k-th symbol by name takes the positions of the k-th drawn one."""
    x = controls.where(F.col("kind") == MATCHED).join(names)
    drawn = x.select("spec", "parent", F.col("symbol").alias("from_symbol"), F.row_number().over(W.partitionBy("spec").orderBy(_drawn(F.col("symbol")), "symbol")).alias("k"))
    named = x.select("spec", "symbol", F.row_number().over(W.partitionBy("spec").orderBy("symbol")).alias("k"))
    return drawn.join(named, ["spec", "k"]).drop("k")


def with_control_positions(positions: DataFrame, cal: DataFrame, names: DataFrame, campaign: int = 0) -> DataFrame:
    """(trial, symbol, pos, from_pos, weight, previous) of real trials and controls; `from_pos` dates the returns."""
    controls = with_controls(positions.select("trial").distinct(), campaign=campaign)
    held = positions.withColumnRenamed("trial", "parent")
    columns = ["trial", "symbol", "pos", "from_pos", "weight", "previous"]
    real = positions.withColumn("from_pos", F.col("pos"))
    dates = held.join(date_permutations(controls, cal), ["parent", "pos"]).withColumnRenamed("spec", "trial")
    labels = held.withColumnRenamed("symbol", "from_symbol").join(label_permutations(controls, names), ["parent", "from_symbol"])
    labels = labels.withColumnRenamed("spec", "trial").withColumn("from_pos", F.col("pos"))
    return real.select(*columns).unionByName(dates.select(*columns)).unionByName(labels.select(*columns))


def control_streams(positions: DataFrame, market: DataFrame, cal: DataFrame, campaign: int = 0) -> DataFrame:
    """Streams of all trials and controls with `parent` and `kind`."""
    names = market.select("symbol").distinct()
    x = S.evaluate(with_control_positions(positions, cal, names, campaign), market, cal, returns_at="from_pos")
    kind = F.when(F.col("trial").endswith(f"|{SHUFFLED}"), SHUFFLED).when(F.col("trial").endswith(f"|{MATCHED}"), MATCHED).otherwise("REAL")
    x = x.withColumn("kind", kind)
    return x.withColumn("parent", F.when(F.col("kind") == "REAL", F.col("trial")).otherwise(F.expr("substring(trial, 1, length(trial) - length(kind) - 1)")))


def survival(tests: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """Survivors of each family and kind and their share: the placebo fraction for controls."""
    hit = F.coalesce(rule, F.lit(False)).cast("double")
    return tests.groupBy(*keys, "kind").agg(F.count("*").alias("n_trials"), F.sum(hit).cast("bigint").alias("n_survivors"), F.avg(hit).alias("fraction"))
