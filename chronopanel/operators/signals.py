"""Signal selection and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_top(x: DataFrame, score: str, k: int) -> DataFrame:
    """Best k names of the newest session with scores, their rank share and an ordinal confidence."""
    scored = x.where(F.col(score).isNotNull())
    newest = scored.agg(F.max("session").alias("session"))
    today = scored.join(F.broadcast(newest), "session")
    one = W.partitionBy("session")
    today = today.select(
        "symbol", "session", score,
        F.row_number().over(one.orderBy(F.col(score).desc(), "symbol")).alias("rank"),
        F.cume_dist().over(one.orderBy(score)).alias("rank_percent"),
    )
    return today.where(F.col("rank") <= k).withColumn("confidence", F.bround(F.lit(100.0) * F.col("rank_percent"), 0))


def rank_recommendations(c: DataFrame, top_n: int = 5, minimum: float = 60.0) -> DataFrame:
    """At most ``top_n`` per session and direction; everything else is kept as skipped."""
    ok = F.col("confidence") >= minimum
    w = W.partitionBy("session", "direction", ok).orderBy(F.col("confidence").desc(), F.col("expected").desc(), "symbol", "id")
    x = c.withColumn("_r", F.row_number().over(w))
    chosen = ok & (F.col("_r") <= top_n)
    return x.select(
        *c.columns, F.when(chosen, F.concat(F.lit("TOP_"), "direction")).otherwise("SKIPPED").alias("bucket"),
        F.when(chosen, F.col("_r")).alias("rank"))


def lexicographic_ranks(profile: DataFrame) -> DataFrame:
    """Loss-first and return-first order of candidates (one row per candidate)."""
    one = W.partitionBy(F.lit(1))
    desc = lambda c: F.col(c).desc()
    return profile.select(
        "*",
        F.row_number().over(one.orderBy(desc("es"), "p_loss", desc("worst"), desc("mean"), "symbol")).alias("loss_first"),
        F.row_number().over(one.orderBy(desc("mean"), desc("es"), "p_loss", "symbol")).alias("return_first"),
    )


def window_means(r: DataFrame, minimum: int) -> DataFrame:
    """Mean return per symbol and calendar window (weekday, month) with enough observations."""
    kinds = F.array(
        F.struct(F.lit("WEEKDAY").alias("kind"), F.weekday("session").cast("string").alias("label")),
        F.struct(F.lit("MONTH").alias("kind"), F.month("session").cast("string").alias("label")),
    )
    x = r.where("ret is not null").select("symbol", "ret", F.inline(kinds))
    return x.groupBy("symbol", "kind", "label").agg(F.round(F.avg("ret"), 9).alias("mean"), F.count("ret").alias("n")).where(
        F.col("n") >= minimum)


def best_worst(m: DataFrame) -> DataFrame:
    key = F.struct("mean", "label")
    return m.groupBy("symbol", "kind").agg(F.max_by("label", key).alias("best"), F.min_by("label", key).alias("worst"))


def compare_symbols(m: DataFrame) -> DataFrame:
    top = m.groupBy("symbol").agg(F.max(F.struct("mean", "label")).alias("t")).select("symbol", "t.label", "t.mean")
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("mean").desc(), "symbol")))


def choice_review(m: DataFrame, chosen: str) -> DataFrame:
    """Rank of a chosen window and the better alternatives, in order."""
    r = m.withColumn("k", F.rank().over(W.partitionBy("symbol").orderBy(F.col("mean").desc())))
    mine = r.where(F.col("label") == chosen).select("symbol", F.col("k").alias("chosen_rank"))
    better = r.join(mine, "symbol").where(F.col("k") < F.col("chosen_rank")).groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("k", "label"))).alias("b"))
    return mine.join(better, "symbol", "left").select(
        "symbol", "chosen_rank", F.coalesce(F.size("b"), F.lit(0)).alias("n_better"),
        F.coalesce(F.array_join(F.transform("b", lambda s: s["label"]), ","), F.lit("")).alias("better"))
