"""Connected components of strongly correlated streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .pairwise import correlated


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node, by label propagation with pointer jumping.

    A round is two equi joins with partial aggregation; jumping to the label's label makes the number of
    rounds logarithmic in the longest chain. Rounds are checkpointed so the plan does not grow.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = cut_lineage(both.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("l"))
        step = labels.join(seen, F.col("node") == F.col("x"), "left").select(
            "node", F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = step.select(F.col("node").alias("m"), F.col("label").alias("far"))
        step = step.join(jump, F.col("label") == F.col("m")).select("node", F.least("label", "far").alias("label"))
        step = cut_lineage(step)
        moved = step.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = step
        if not moved:
            return labels


def clusters(df: DataFrame, key: str, order: str, value: str, threshold: float = 0.7, minimum: int = 20) -> DataFrame:
    nodes = df.select(F.col(key).alias("node")).distinct()
    out = components(nodes, correlated(df, key, order, value, threshold, minimum))
    return out.select(F.col("node").alias(key), F.col("label").alias("cluster"))


def cluster_weights(c: DataFrame) -> DataFrame:
    """Each cluster gets the same weight, shared equally by its members."""
    size = c.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    total = size.agg(F.count("*").alias("n"))
    return c.join(size, "cluster").join(F.broadcast(total)).withColumn(
        "weight", F.lit(1.0) / F.col("n") / F.col("cluster_size")).drop("n")
