"""The sealed window: frozen edges, their composite and its overlays, resampled together and judged once.

Edges and weights come from the sessions before the window alone. Every series of the window is drawn along the same
paths, so intervals of edges and composite belong to one resample of dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bootstrap as B
from .clusters import cluster_weights, clusters
from .inference import summarize

EDGE, COMPOSITE, OVERLAY = "EDGE", "COMPOSITE", "OVERLAY"


def frozen_edges(streams: DataFrame, start: str, threshold: float = 0.7) -> DataFrame:
    """(trial, cluster, weight) of the trials with a positive net mean before the window; clusters weigh alike."""
    before = streams.where(F.col("session") < F.lit(start).cast("date"))
    chosen = before.groupBy("trial").agg(F.avg("net").alias("m")).where("m > 0").select("trial")
    return cluster_weights(clusters(before.join(chosen, "trial", "left_semi"), "trial", "pos", "net", threshold))


def sealed_series(streams: DataFrame, frozen: DataFrame, overlays: DataFrame, start: str) -> DataFrame:
    """(kind, series, pos, v) inside the window. `overlays` has (overlay, pos, on): what the composite gains by staying
    out while the overlay is off. Sessions that an overlay does not know are left as they are."""
    inside = streams.where(F.col("session") >= F.lit(start).cast("date")).join(frozen.select("trial", "weight"), "trial")
    edges = inside.select(F.lit(EDGE).alias("kind"), F.col("trial").alias("series"), "pos", F.col("net").alias("v"))
    whole = inside.groupBy("pos").agg(F.sum(F.col("net") * F.col("weight")).alias("v"))
    composite = whole.select(F.lit(COMPOSITE).alias("kind"), F.lit("ALL").alias("series"), "pos", "v")
    gain = whole.join(overlays, "pos").select(F.lit(OVERLAY).alias("kind"), F.col("overlay").alias("series"), "pos", F.when(F.col("on"), 0.0).otherwise(-F.col("v")).alias("v"))
    return edges.unionByName(composite).unionByName(gain)


def evaluate(series: DataFrame, window: DataFrame, draws: int, minimum: int = 20, confidence: float = 0.95, most: int = 256) -> DataFrame:
    """Mean, annual Sharpe and percentile intervals of every series on shared paths over the window's sessions.

    `window` has (pos, idx), idx from 0 without gaps. A session without a row counts as zero in a resample. A series of
    fewer than `minimum` sessions has no interval.
    """
    n = window.count()
    named = series.withColumn("trial", F.concat_ws("|", "kind", "series"))
    own = summarize(named, ["kind", "series", "trial"], "v").select("kind", "series", "trial", "n", "mean", "sharpe")
    if n < 2:
        return own.drop("trial").withColumns({c: F.lit(None).cast("double") for c in ("mean_low", "mean_high", "sharpe_low", "sharpe_high")})
    counts = B.date_counts(B.stationary_paths(series.sparkSession, n, draws))
    values = named.join(F.broadcast(window), "pos").select("trial", "idx", "v")
    blocks = max(1, -(-own.count() // most))
    intervals = B.intervals_of_sums(B.blocked_sums(counts, values, n, trial_blocks=blocks), n, confidence).drop("n_reps")
    x = own.join(intervals, "trial", "left").drop("trial")
    enough = F.col("n") >= minimum
    return x.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_low", "mean_high", "sharpe_low", "sharpe_high")})


def decide(evaluated: DataFrame, profile: str = "full") -> DataFrame:
    """One row for each evaluator. SIGN_V1 asks for positive means and overlays that do not harm; CI_V2 also for lower
    bounds above zero, and a missing bound fails. Promotion needs a passed gate, at least one edge and the full profile.
    """
    is_ = lambda kind: F.col("kind") == kind
    every = lambda kind, rule: F.coalesce(F.bool_and(F.when(is_(kind), F.coalesce(rule, F.lit(False)))), F.lit(True))
    sums = evaluated.agg(
        F.count_if(is_(EDGE)).alias("n_edges"), F.count_if(is_(COMPOSITE)).alias("_composites"),
        every(EDGE, F.col("mean") > 0).alias("edge_positive"), every(COMPOSITE, F.col("mean") > 0).alias("_composite"),
        every(OVERLAY, F.col("mean") >= 0).alias("overlays_nonnegative"),
        every(EDGE, F.col("mean_low") > 0).alias("_edge_low"), every(COMPOSITE, F.col("mean_low") > 0).alias("_composite_low"))
    none, there = F.col("n_edges") == 0, F.col("_composites") > 0
    x = sums.withColumn("composite_positive", none | (there & F.col("_composite"))).withColumn("_composite_low", none | (there & F.col("_composite_low")))
    signs = F.col("edge_positive") & F.col("composite_positive") & F.col("overlays_nonnegative")
    unknown = F.lit(None).cast("boolean")
    rows = F.array(
        F.struct(F.lit("SIGN_V1").alias("evaluator"), unknown.alias("edge_low_positive"), unknown.alias("composite_low_positive"), signs.alias("research_gate_pass")),
        F.struct(F.lit("CI_V2").alias("evaluator"), F.col("_edge_low").alias("edge_low_positive"), F.col("_composite_low").alias("composite_low_positive"), (signs & F.col("_edge_low") & F.col("_composite_low")).alias("research_gate_pass")))
    out = x.select("n_edges", "edge_positive", "composite_positive", "overlays_nonnegative", F.inline(rows))
    return out.withColumn("promoted", F.col("research_gate_pass") & (F.col("n_edges") > 0) & F.lit(profile == "full"))


def diagnostic(decisions: DataFrame) -> DataFrame:
    """Would a result sealed under SIGN_V1 have passed CI_V2? A report; it changes no sealed verdict."""
    of = lambda name, c: F.max(F.when(F.col("evaluator") == name, F.col(c)))
    return decisions.agg(
        of("SIGN_V1", "research_gate_pass").alias("sealed_pass"), of("CI_V2", "research_gate_pass").alias("ci_v2_would_pass"),
        of("CI_V2", "edge_low_positive").alias("edge_low_positive"), of("CI_V2", "composite_low_positive").alias("composite_low_positive"))
