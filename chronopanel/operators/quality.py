"""Gates and audits over bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = ("event_id", "available_at", "fetched_at", "content_hash")


def provenance_faults(available: str = "available_at", fetched: str = "fetched_at", digest: str = "content_hash") -> Column:
    return (
        F.col(available).isNull() | F.col(fetched).isNull() | (F.col(fetched) < F.col(available))
        | ~F.coalesce(F.col(digest).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    )


def provenance_ok(df: DataFrame) -> DataFrame:
    """Rows unchanged; the job fails on the first row with broken provenance."""
    check = F.when(provenance_faults(), F.raise_error(F.lit("invalid provenance"))).otherwise(F.lit(True)).cast("boolean")
    return df.where(check)


def bar_rules() -> dict[str, Column]:
    """Violations of a canonical bar, by rule name."""
    c = F.col
    return {
        "missing_key": c("symbol").isNull() | c("session").isNull(),
        "availability": ~F.coalesce(c("available_at") > c("event_time"), F.lit(False)),
        "price": F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(True)),
        "range": (c("high") < F.greatest("open", "close", "low") - F.lit(1e-12)) | (c("low") > F.least("open", "close", "high") + F.lit(1e-12)),
        "volume": F.coalesce(c("volume") < 0, F.lit(True)),
    }


def bar_gate(bars: DataFrame) -> DataFrame:
    """Violation counts of every rule in one pass, plus duplicate keys."""
    rules = bar_rules()
    counts = bars.agg(F.count("*").alias("n_rows"), *[F.count_if(r).alias(n) for n, r in rules.items()])
    twice = bars.groupBy("symbol", "session").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicates"))
    return counts.join(twice)


def quarantine(bars: DataFrame) -> DataFrame:
    """Every row with its list of violations; clean rows carry an empty list."""
    from .filters import reasons

    return bars.withColumn("violations", reasons(**bar_rules()))


def missing_columns(df: DataFrame, required) -> list[str]:
    return sorted(set(required) - set(df.columns))


def single_sessions(bars: DataFrame) -> DataFrame:
    """Drop every copy of a repeated (symbol, session)."""
    from pyspark.sql import Window as W

    n = F.count("*").over(W.partitionBy("symbol", "session"))
    return bars.withColumn("_n", n).where("_n = 1").drop("_n")


def missing_sessions(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Calendar sessions inside a symbol's life without a bar. The calendar is one array in one row."""
    life = bars.groupBy("symbol").agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    days = cal.agg(F.array_sort(F.collect_list("session")).alias("days"))
    inside = F.filter("days", lambda d: (d >= F.col("lo")) & (d <= F.col("hi")))
    want = life.join(F.broadcast(days)).select("symbol", F.explode(inside).alias("session"))
    return want.join(bars.select("symbol", "session"), ["symbol", "session"], "left_anti")


def price_checks(bars: DataFrame, sigma: float = 10.0, minimum: int = 20, jump: float = 0.4) -> DataFrame:
    """Own-row checks: causal z-score outliers, unexplained jumps, zero volume."""
    from pyspark.sql import Window as W

    own = W.partitionBy("symbol").orderBy("session")
    past = own.rowsBetween(W.unboundedPreceding, -1)
    lr = F.ln(F.col("adjusted_close") / F.lag("adjusted_close").over(own))
    x = bars.withColumn("lr", lr).withColumn("raw_ret", F.col("close") / F.lag("close").over(own) - 1).withColumn(
        "adj_ret", F.col("adjusted_close") / F.lag("adjusted_close").over(own) - 1)
    sd = F.stddev_samp("lr").over(past)
    z = F.when(F.count("lr").over(past) >= minimum, (F.col("lr") - F.avg("lr").over(past)) / F.nullif(sd, F.lit(0.0)))
    explained = (F.col("split_factor") != 1) | (F.col("dividend") != 0) | (F.abs(F.abs("raw_ret") - F.abs("adj_ret")) > 0.10)
    return x.select(
        "symbol", "session", z.alias("z"), F.coalesce(F.abs(z) > sigma, F.lit(False)).alias("outlier"),
        F.coalesce((F.abs("raw_ret") > jump) & ~explained, F.lit(False)).alias("jump"), (F.coalesce("volume", F.lit(0.0)) <= 0).alias("zero_volume"))


def stale_runs(bars: DataFrame, price: str = "close", minimum: int = 3) -> DataFrame:
    """Runs of unchanged prices: first and last session and length."""
    from pyspark.sql import Window as W

    own = W.partitionBy("symbol").orderBy("session")
    moved = F.coalesce((F.col(price) != F.lag(price).over(own)).cast("int"), F.lit(1))
    x = bars.withColumn("_m", moved).withColumn("_run", F.sum("_m").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("symbol", "_run").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.count("*").alias("length")).where(
        F.col("length") >= minimum)


def audit(bars: DataFrame, cal: DataFrame, sigma: float = 4.0, jump: float = 0.4, stale: int = 2) -> DataFrame:
    """One row per instrument: coverage, zero volume, stale runs, outliers, unexplained jumps."""
    clean = single_sessions(bars)
    checks = price_checks(clean, sigma, jump=jump).groupBy("symbol").agg(
        F.count("*").alias("observed"), F.count_if("zero_volume").alias("zero_volume"), F.count_if("outlier").alias("outliers"), F.count_if("jump").alias("jumps"))
    gaps = missing_sessions(clean, cal).groupBy("symbol").agg(F.count("*").alias("missing"))
    runs = stale_runs(clean, minimum=stale).groupBy("symbol").agg(F.count("*").alias("stale_runs"))
    zero = F.lit(0)
    x = checks.join(gaps, "symbol", "left").join(runs, "symbol", "left")
    x = x.withColumn("missing", F.coalesce("missing", zero)).withColumn("stale_runs", F.coalesce("stale_runs", zero))
    return x.withColumn("expected", F.col("observed") + F.col("missing")).withColumn("missing_fraction", F.col("missing") / F.col("expected"))


def issues(audit_rows: DataFrame) -> DataFrame:
    """Audit counts as a long issue table."""
    codes = {"missing": "MISSING_BAR", "zero_volume": "ZERO_VOLUME", "stale_runs": "STALE_PRICE", "outliers": "CAUSAL_OUTLIER", "jumps": "UNEXPLAINED_JUMP"}
    rows = F.array(*[F.struct(F.lit(v).alias("code"), F.col(k).cast("bigint").alias("n")) for k, v in codes.items()])
    return audit_rows.select("symbol", F.inline(rows)).where("n > 0")


def table_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Order- and partition-free digest of a table: its row count, and the eight 32-bit words of the rows' SHA-256, each
    summed over the rows. Rows are read as their columns' texts in order, nulls apart from empty texts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    x = df.select(*(by or []), F.sha2(text, 256).alias("_h"))
    word = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    part = lambda k: F.lower(F.lpad(F.hex((F.sum(word(k)) % 2**32).cast("bigint")), 8, "0"))
    aggs = (F.count("*").alias("n_rows"), F.concat(*[part(k) for k in range(8)]).alias("digest"))
    return x.groupBy(*by).agg(*aggs) if by else x.agg(*aggs)


def coverage(bars: DataFrame, cal: DataFrame) -> DataFrame:
    total = cal.agg(F.count("*").alias("expected"))
    x = bars.groupBy("symbol").agg(
        F.count_distinct("session").alias("observed"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    return x.join(F.broadcast(total)).select(
        "*", (F.col("observed") / F.col("expected")).alias("coverage"), (F.datediff("last_session", "first_session") / F.lit(365.2425)).alias("years"))


def survivorship(intended: DataFrame, available: DataFrame, point_in_time: bool) -> DataFrame:
    x = intended.select("symbol").distinct().withColumn("want", F.lit(1)).join(
        available.select("symbol").distinct().withColumn("have", F.lit(1)), "symbol", "full")
    s = x.agg(F.count("want").alias("intended"), F.count_if(F.col("want").isNotNull() & F.col("have").isNotNull()).alias("available"))
    lost = F.col("intended") - F.col("available")
    return s.select("*", (lost / F.greatest("intended", F.lit(1))).alias("missing_fraction"),
                    F.when(F.lit(point_in_time) & (lost == 0), "POINT_IN_TIME").otherwise("SURVIVORSHIP_BIASED").alias("bias"))
