"""Expanding-history statistics: rank and quantiles of everything seen before a row.

Values become ranks, ranks are read as digits from the top, and the digits span a tree: a node holds the values with
the same leading digits. What a row needs of its past is how many earlier values of a node had each next digit. That
is a running count inside a run of the calendar plus the counts of all runs before it, so no task holds the past of a
series and no row carries it. A rank adds the counts of smaller digits along its own path; a quantile walks down the
tree to the value with a given number of smaller ones. Both take one pass over the rows for each digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BITS, RUN = 4, 512  # of a digit; positions in a run of the calendar
DIGITS = 1 << BITS


def dense_ranks(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank from 0) of the distinct values of each key; the order is made in ranges of (key, value)."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.select(*keys, value).distinct().repartitionByRange(parts, *keys, value)
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(value)) - 1
    return ranged.withColumn("_own", own).join(starts, [*keys, "_part"]).select(*keys, value, (F.col("_start") + F.col("_own")).alias("rank"))


def _digit(rank: Column, level: Column, levels: int) -> Column:
    return F.floor(rank / F.pow(F.lit(float(DIGITS)), F.lit(levels - 1) - level)).cast("bigint") % DIGITS


def _node(rank: Column, level: Column, levels: int) -> Column:
    return F.floor(rank / F.pow(F.lit(float(DIGITS)), F.lit(levels) - level)).cast("bigint")


def counts_before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`before`: for each digit, the rows of the node at earlier positions that have it. Rows without a digit only ask."""
    group = [*keys, "level", "node"]
    rows = rows.withColumn("_run", F.floor(F.col(order) / RUN))
    inside = W.partitionBy(*group, "_run").orderBy(order).rangeBetween(W.unboundedPreceding, -1)
    has = [(F.col("digit") == d).cast("bigint") for d in range(DIGITS)]
    none = F.lit(0).cast("bigint")
    totals = rows.groupBy(*group, "_run").agg(*[F.coalesce(F.sum(h), none).alias(f"_t{d}") for d, h in enumerate(has)])
    runs = W.partitionBy(*group).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "_run", F.array(*[F.coalesce(F.sum(f"_t{d}").over(runs), none) for d in range(DIGITS)]).alias("_start"))
    own = rows.withColumn("_own", F.array(*[F.coalesce(F.sum(h).over(inside), none) for h in has]))
    both = own.join(starts, [*group, "_run"])
    return both.withColumn("before", F.zip_with("_start", "_own", lambda a, b: a + b)).drop("_run", "_start", "_own")


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)


def _valued(df: DataFrame, value: str, keys: list[str], order: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with a value and its rank, the table of ranks, and the number of digits that the largest rank has."""
    x = df.select(*keys, order, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    ranks = cut_lineage(dense_ranks(x, keys, "_x"))
    most = ranks.agg(F.max("rank")).first()[0] or 0
    return x.join(ranks, [*keys, "_x"]), ranks, max(1, -(-int(most).bit_length() // BITS))


def expanding_percentile(df: DataFrame, value: str, minimum: int = 252, key: str = "symbol", order: str = "pos") -> DataFrame:
    """Share of earlier values below a row's value, equal ones counted half, over one more than their number."""
    x, _, levels = _valued(df, value, [key], order)
    rows = x.select(key, order, "rank", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    rows = rows.select(key, order, "level", _node(F.col("rank"), F.col("level"), levels).alias("node"), _digit(F.col("rank"), F.col("level"), levels).alias("digit"))
    met = counts_before(rows, [key], order)
    last = F.col("level") == levels - 1
    out = met.groupBy(key, order).agg(
        F.sum(_sum(F.slice("before", F.lit(1), F.col("digit").cast("int")))).alias("_below"),
        F.max(F.when(last, F.element_at("before", F.col("digit").cast("int") + 1))).alias("_equal"),
        F.max(F.when(F.col("level") == 0, _sum(F.col("before")))).alias("_seen"))
    rank = (F.col("_below") + F.col("_equal") / F.lit(2.0)) / (F.col("_seen") + 1)
    out = out.select(key, order, F.when(F.col("_seen") >= minimum, rank).alias("percentile"))
    return df.join(out, [key, order], "left")


def expanding_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], minimum: int, key: str = "symbol", order: str = "pos") -> DataFrame:
    """Linear-interpolated quantiles of strictly earlier values."""
    x, ranks, levels = _valued(df, value, [key], order)
    x = cut_lineage(x.select(key, order, "rank"))
    asked = df.select(key, order).distinct()

    def met(level: int, probes: DataFrame) -> DataFrame:
        """Counts before the probes of one level; the values of the level stand among them."""
        at = F.lit(level)
        held = x.select(key, order, at.alias("level"), _node(F.col("rank"), at, levels).alias("node"), _digit(F.col("rank"), at, levels).alias("digit"))
        found = counts_before(probes.withColumn("level", at).unionByName(held, allowMissingColumns=True), [key], order)
        return found.where("digit is null")

    first = met(0, asked.withColumn("node", F.lit(0).cast("bigint"))).withColumn("_seen", _sum(F.col("before"))).where(F.col("_seen") >= max(1, minimum))
    place = lambda q: (F.col("_seen") - 1) * F.lit(float(q))
    ends = [F.struct(F.lit(n).alias("name"), F.lit(e).alias("end"), F.least(F.floor(place(q)).cast("bigint") + e, F.col("_seen") - 1).alias("k"), (place(q) - F.floor(place(q))).alias("part"))
            for n, q in quantiles.items() for e in (0, 1)]
    probes = first.select(key, order, "node", "before", F.explode(F.array(*ends)).alias("_e")).select(key, order, "node", "before", "_e.*")

    def down(found: DataFrame) -> DataFrame:
        """To the child that holds the k-th of the earlier values; k becomes its place there."""
        upto = F.transform(F.sequence(F.lit(1), F.lit(DIGITS)), lambda d: _sum(F.slice("before", F.lit(1), d)))
        y = found.withColumn("_u", upto).withColumn("_d", F.size(F.filter("_u", lambda c: c <= F.col("k"))))
        k = F.col("k") - F.when(F.col("_d") > 0, F.element_at("_u", F.greatest(F.col("_d"), F.lit(1)))).otherwise(0)
        return y.select(key, order, "name", "end", "part", k.alias("k"), (F.col("node") * DIGITS + F.col("_d")).alias("node"))

    probes = down(probes)
    for level in range(1, levels):
        probes = down(met(level, cut_lineage(probes)))
    named = probes.join(ranks.select(key, F.col("rank").alias("node"), "_x"), [key, "node"])
    low, high = (F.max(F.when(F.col("end") == e, F.col("_x"))) for e in (0, 1))
    found = named.groupBy(key, order, "name").agg((low + (high - low) * F.max("part")).alias("_v"))
    wide = found.groupBy(key, order).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in quantiles])
    return df.join(wide, [key, order], "left")


