"""Streams over landed files, each with an exactly-once file sink and its own checkpoint.

A finished folder can hold any number of files in any order, and its answer must not depend on that. So streams that
drop state by a watermark declare a lateness that covers the folder, streams whose answer depends on arrival are fed
in arrival order, and a stream that dropped a row as late fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from ..sources.ticks import as_ticks
from .stateful import KEY, Fold, folded, folded_schema


class LateRows(RuntimeError):
    """A stream dropped rows behind its watermark."""


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events*.parquet")


def tick_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 16) -> DataFrame:
    """The event table as a stream of ticks."""
    schema = landed(spark, sf_dir).schema
    return as_ticks(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events*.parquet"))


def whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished folder as one batch: a decision run is one unit and must not be cut between batches."""
    return as_ticks(spark.readStream.schema(landed(spark, sf_dir).schema).parquet(f"{sf_dir}/events*.parquet"))


def lateness(spark: SparkSession, sf_dir: str) -> str:
    """The time that the folder spans: no row of it can be later than that."""
    span = landed(spark, sf_dir).agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("s")).first()["s"]
    return f"{int(span or 0) + 60} seconds"


def _settle(query) -> None:
    query.awaitTermination()
    dropped = sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise LateRows(f"{dropped} rows came behind the watermark; declare a longer lateness")


def drain(stream: DataFrame, name: str, mode: str = "append", partition_by: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return what its file sink holds."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", check)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _settle(writer.trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, keys: list[str], version: str = "batch") -> DataFrame:
    """Run an aggregating stream in update mode. Each batch lands in a folder of its own, so a repeated batch writes
    the same folder again; the newest version of a key counts, and open windows are there too."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{version}={epoch}")

    _settle(stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).start())
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField(version, T.IntegerType())])).parquet(out)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in stream.columns])


def drain_in_order(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], name: str, order: str = "event_id", ranges: int = 3, fold: Fold | None = None) -> DataFrame:
    """Replay a finished folder in arrival order: ranges of `order` land one after another, and the stream runs from its
    checkpoint after each. Rows of a key are ordered inside a batch by the state, and batches follow each other.

    With a `fold`, each batch writes its answers and the states it leaves to a folder of its own, from the states of the
    batch before; a batch that is run again writes the same folder again."""
    events = landed(spark, sf_dir)
    ship_package(spark)
    folder, out, check = (scratch_path(spark, f"{name}-{part}") for part in ("landing", "out", "checkpoint"))
    cuts = sorted(set(events.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.01)))
    edges = [None, *cuts, None]
    schema = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = events if low is None else events.where(F.col(order) >= low)
        if high is not None:  # rows without an order come first
            part = part.where(F.coalesce(F.col(order) < high, F.lit(True)))
        part.write.mode("append").parquet(folder)
        stream = build(as_ticks(spark.readStream.schema(events.schema).parquet(folder)))
        schema = stream.schema
        if fold is not None:
            _settle(stream.writeStream.foreachBatch(_folding(fold, out)).option("checkpointLocation", check).trigger(availableNow=True).start())
            continue
        _settle(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
    if fold is not None:
        held = folded_schema(fold)
        return spark.read.schema(held.add("batch", T.IntegerType())).parquet(out).where("not held").select(KEY, *T.StructType.fromDDL(fold.answer).names)
    return spark.read.schema(schema).parquet(out)


def _folding(fold: Fold, out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, epoch: int) -> None:
        before = None
        if epoch:
            before = batch.sparkSession.read.schema(folded_schema(fold)).parquet(f"{out}/batch={epoch - 1}").where("held")
        folded(batch, before, fold).write.mode("overwrite").partitionBy("held").parquet(f"{out}/batch={epoch}")

    return write


def minute_bars(ticks: DataFrame, late: str) -> DataFrame:
    """Tumbling minute bars with VWAP; `late` is how long a window stays open behind the newest tick."""
    x = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute").alias("w")).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("traded"))
    return x.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", (F.col("traded") / F.nullif("volume", F.lit(0.0))).alias("vwap"))


def first_capture(ticks: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One row per key within the watermark; repeats are ignored, state is dropped as time moves on."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fresh_quotes(signals: DataFrame, quotes: DataFrame, late: str, minutes: int = 30) -> DataFrame:
    """Signals with quotes of the last ``minutes`` (interval join; both sides bounded by watermarks).

    The key carries a time bucket as wide as the interval, so a busy user's state and rows spread over
    buckets; a signal looks into its own bucket and the one before.
    """
    wide = minutes * 60
    own = F.floor(F.unix_timestamp("signal_at") / wide)
    s = signals.withWatermark("signal_at", late).withColumn("bucket", F.explode(F.array(own, own - 1)))
    q = quotes.withWatermark("quote_at", late).withColumn("quote_bucket", F.floor(F.unix_timestamp("quote_at") / wide))
    near = (F.col("user_id") == F.col("quote_user")) & (F.col("bucket") == F.col("quote_bucket")) & (F.col("quote_at") <= F.col("signal_at")) & (
        F.col("quote_at") >= F.col("signal_at") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return s.join(q, near)


def newest_quotes(found: DataFrame) -> DataFrame:
    """The newest quote of each signal; the larger quote_id among those of one moment."""
    newest = found.groupBy("event_id").agg(F.max_by(F.struct("quote_id", "quote_price"), F.struct("quote_at", "quote_id")).alias("q"))
    return newest.select("event_id", "q.quote_id", "q.quote_price")


def insert_new_runs(stream: DataFrame, run: str, terms: list[str], allowed: dict[str, tuple], name: str, out: str | None = None) -> DataFrame:
    """Append whole runs that are not stored yet.

    All rows of a run go in, or none. A run whose rows disagree on its terms (leverage, horizon), or have terms that
    are not allowed, is refused. The sink is partitioned by batch, and a batch that is run again writes its own
    partition again; a run that an earlier batch has stored is left as it is.
    """
    spark = stream.sparkSession
    out, check = out or scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    stored = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], stored).write.mode("append").partitionBy("batch").parquet(out)

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(stored).parquet(out).where(F.col("batch") != epoch).select(run).distinct()
        fits = F.lit(True)
        for column, values in allowed.items():
            fits = fits & F.coalesce(F.col(column).isin(*values), F.lit(False))
        sound = batch.groupBy(run).agg(F.bool_and(fits).alias("fits"), *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in terms])
        sound = sound.where("fits").where(" AND ".join(f"n_{c} = 1" for c in terms)).select(run)
        fresh = batch.join(sound, run, "left_semi").join(known, run, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _settle(stream.writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start())
    return spark.read.schema(stored).parquet(out).select(*stream.columns)
