"""Partitioned snapshots of bar tables, their readers, and content-addressed artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def representations(bars: DataFrame) -> DataFrame:
    """Raw, adjusted and action rows of one bar table."""
    factor = F.col("adjusted_close") / F.col("close")
    raw = bars.select("symbol", "session", F.lit("raw").alias("representation"), *PRICES, "volume")
    adjusted = bars.select("symbol", "session", F.lit("adjusted").alias("representation"),
                           *[(F.col(c) * factor).alias(c) for c in PRICES], (F.col("volume") / factor).alias("volume"))
    act = bars.where("dividend <> 0 or split_factor <> 1").select(
        "symbol", "session", F.lit("actions").alias("representation"),
        F.when(F.col("dividend") != 0, F.col("dividend")).otherwise(F.col("split_factor")).alias("close"))
    return raw.unionByName(adjusted).unionByName(act, allowMissingColumns=True)


def write_snapshot(bars: DataFrame, path: str) -> None:
    """zstd Parquet by representation and year; clustered so that each task writes few files."""
    x = representations(bars).withColumn("year", F.year("session"))
    x.repartition("representation", "year").write.mode("errorifexists").option("compression", "zstd").partitionBy("representation", "year").parquet(path)


def read_snapshot(spark: SparkSession, path: str, representation: str = "adjusted", columns=("symbol", "session", "close")) -> DataFrame:
    """Partition- and column-pruned read of one representation."""
    return spark.read.parquet(path).where(F.col("representation") == representation).select(*columns)


def rebuild_bars(snapshot: DataFrame) -> DataFrame:
    raw = snapshot.where("representation = 'raw'").select("symbol", "session", *PRICES, "volume")
    adj = snapshot.where("representation = 'adjusted'").select("symbol", "session", F.col("close").alias("adjusted_close"))
    return raw.join(adj, ["symbol", "session"])


def latest_snapshots(catalogue: DataFrame) -> DataFrame:
    """Newest snapshot per asset."""
    return catalogue.groupBy("asset").agg(F.max(F.struct("fetched_at", "snapshot_id")).alias("t")).select("asset", "t.*")


def write_artifact(df: DataFrame, root: str) -> tuple[str, bool]:
    """Immutable write to a path that carries the table's digest: (path, whether it was written now). A table that is
    there already is left as it is, and no other table can come to its path."""
    from pyspark.errors import AnalysisException

    from ..operators.quality import table_digest

    path = f"{root}/{table_digest(df).first()['digest']}"
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return path, False
    return path, True
