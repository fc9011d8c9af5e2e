"""Records with two clocks: when something held (valid time) and when it could be known (knowledge time).

A record may arrive after a newer one. What is known at a moment is the newest record by valid time among those that
have arrived, not the one that arrived last. So arrivals become steps, rows at which the best known record changes, and
a question is an as-of join on those steps; a key with a third of all records is swept in time buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join


def knowledge_steps(vintages: DataFrame, keys: list[str], valid: list[str], known: str, take: list[str]) -> DataFrame:
    """(keys, known, take) where an arrival is newer by `valid` than all that arrived before it.

    Arrivals at one moment count together. The running best is taken in runs of 30 days and over their maxima."""
    rank = F.struct(*valid, *[c for c in take if c not in valid])
    moments = vintages.where(F.col(known).isNotNull()).groupBy(*keys, known).agg(F.max(rank).alias("_best"))
    moments = moments.withColumn("_run", F.floor(F.unix_micros(F.col(known).cast("timestamp")) / (30 * 86_400_000_000)))
    runs = moments.groupBy(*keys, "_run").agg(F.max("_best").alias("_top"))
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", F.max("_top").over(before).alias("_carried"))
    inside = W.partitionBy(*keys, "_run").orderBy(known).rowsBetween(W.unboundedPreceding, -1)
    x = moments.withColumn("_earlier", F.max("_best").over(inside)).join(runs, [*keys, "_run"])
    best = F.greatest("_earlier", "_carried")
    return x.where(best.isNull() | (F.col("_best") > best)).select(*keys, known, *[F.col(f"_best.{c}").alias(c) for c in take])


def known_at(questions: DataFrame, vintages: DataFrame, keys: list[str], at: str, valid: list[str], known: str, take: list[str]) -> DataFrame:
    """Questions with the newest record by `valid` that had arrived at the moment `at`."""
    steps = knowledge_steps(vintages, keys, valid, known, take)
    return asof_join(questions, steps, keys, at, known, take, bucket_seconds=30 * 86400).withColumnRenamed("matched_at", "known_since")


def vintage_faults(vintages: DataFrame, identity: list[str], event: str, known: str, fetched: str) -> DataFrame:
    """One row for each gate: its name, the rows it saw, and the rows (or identities) that break it."""
    copies = vintages.groupBy(*identity).agg(F.count("*").alias("_c"))
    own = vintages.agg(
        F.count("*").alias("n"), F.count_if(F.col(known) < F.col(event)).alias("KNOWN_BEFORE_EVENT"), F.count_if(F.col(fetched) < F.col(known)).alias("FETCHED_BEFORE_KNOWN"),
        F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in (*identity, event, known, fetched)]) == 1).alias("MISSING_VALUE"))
    twice = copies.agg(F.count_if(F.col("_c") > 1).alias("DUPLICATE_REVISION"))
    gates = ("DUPLICATE_REVISION", "KNOWN_BEFORE_EVENT", "FETCHED_BEFORE_KNOWN", "MISSING_VALUE")
    x = own.join(twice).select("n", F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("n_faults")) for g in gates])))
    return x.select("gate", F.col("n").alias("n_rows"), "n_faults", F.when(F.col("n_faults") == 0, "PASS").otherwise("BLOCK").alias("status"))


def valid_at(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """Rows with the interval (start, end, known) that held at the clock and was known by then; at most one may hold.

    Intervals of a key do not overlap, so the newest one that has begun decides; an interval that was not yet known, or
    has ended, leaves nulls."""
    ends = intervals.select(*keys, F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("_end"), F.col("known").cast("timestamp").alias("_known"), *take)
    met = asof_join(rows, ends, keys, at, "start", ["_end", "_known", *take], bucket_seconds=365 * 86400)
    clock = F.col(at).cast("timestamp")
    holds = (F.col("_end").isNull() | (clock < F.col("_end"))) & (F.col("_known") <= clock)
    return met.select(*rows.columns, *[F.when(holds, F.col(c)).alias(c) for c in take])
