"""Mixing of sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and with it, in a shuffled order, divided by
the target of the source. A source may be used twice, so a document has two finish times, one for each pass. Passes
of which half or more lies before time 1, at which a source reaches its target, stand in one order by finish time, and
the mix is the longest start of that order that fits the total budget. So a source is over its target by half a
document at most, and below it by less than one.

Nulls: a null text has size 0, a null source is a source of its own and stands last, a null doc_id is shuffled like any
other value. A document of size 0 takes 0 words. Repeated rows are rows of their own. An empty table gives an empty
result. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, staged, text_or_empty

QUERY = "op1_mixing"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLOTS = 4096  # parts of one unit of virtual time; only one of them is ever sorted


def sized(docs: DataFrame, *carry) -> DataFrame:
    """doc_id, source, size and the shuffle key of each row; the text is not needed after this."""
    return docs.select(
        "doc_id", "source", *carry,
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw"),
    )


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source. The common level of target by weight is the largest over the sources in order of their
    limit by weight, of what is left for a source and those after it, divided by their weights."""
    every, order = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    filling = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most"))
    left = F.sum("source_size").over(every) * float(share) - (F.sum("most").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("most"))
    shares = F.sum("weight").over(every) - (F.sum("weight").over(filling.rowsBetween(W.unboundedPreceding, 0)) - F.col("weight"))
    level = F.max("level").over(every)
    return sources.withColumn("level", left / shares).withColumn("level", level).select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def finish_times(rows: DataFrame, goals: DataFrame, *carry: str) -> DataFrame:
    """Words of the source before each document, summed over (source, start of the shuffle key) first: a source
    with a third of all rows is dealt out over 4096 parts."""
    part = F.substring("draw", 1, 3)
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")).select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    goals = goals.withColumnRenamed("source", "goal_source")
    parts = parts.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("part_source"), F.col("part").alias("of_part"), "before", "source_size", "target")
    within = W.partitionBy("source", "part").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("part", part).withColumn("within", F.sum("size").over(within))
    joined = rows.join(parts, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("of_part")))
    words = F.col("before") + F.col("within")

    def finish(words):
        timely = (F.col("target") > 0) & (F.col("size") > 0) & (words - F.col("size") / 2.0 <= F.col("target"))
        return F.when(timely, words / F.col("target"))

    return joined.select(*carry, "doc_id", "source", "draw", "size", "source_size", "target", finish(words).alias("finish_1"), finish(F.col("source_size") + words).alias("finish_2"))


def mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words) of every row."""
    return _taken(staged(sized(docs), "mix-sizes"), share)


def repeated(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of the mix: each row of the input as often as it is taken. Rows meet their counts by a row number."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "mix-rows")
    rows = staged(sized(numbered.select("rid", "row.doc_id", "row.text", "row.source"), "rid"), "mix-sizes")
    counts = _taken(rows, share, "rid").filter("taken > 0").select("rid", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return numbered.join(counts, "rid").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def _taken(rows: DataFrame, share: float, *carry: str) -> DataFrame:
    timed = staged(finish_times(rows, targets(rows, share=share), *carry), "mix-times")
    slot = F.least(F.floor(F.col("finish") * SLOTS), F.lit(8 * SLOTS)).cast("long")
    passes = timed.select("doc_id", "draw", "size", F.explode(F.array("finish_1", "finish_2")).alias("finish")).filter("finish IS NOT NULL").withColumn("slot", slot)
    budget = timed.agg(F.sum("size")).first()[0] or 0
    running = F.sum("words").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    over = passes.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("till", running).filter(F.col("till") > budget * share).orderBy("slot").first()
    item = F.struct("finish", "draw", "doc_id")
    if over is None:  # all timely passes fit the budget
        taken = [F.lit(True), F.lit(True)]
    else:
        order = W.partitionBy("slot").orderBy("finish", "draw", "doc_id").rowsBetween(W.unboundedPreceding, 0)
        fits = passes.filter(F.col("slot") == over["slot"]).withColumn("till", F.sum("size").over(order) + (over["till"] - over["words"])).filter(F.col("till") <= budget * share)
        last = fits.agg(F.max(item).alias("last")).first()["last"]
        taken = []
        for name in ("finish_1", "finish_2"):
            at = F.least(F.floor(F.col(name) * SLOTS), F.lit(8 * SLOTS)).cast("long")
            inside = F.lit(False) if last is None else F.struct(F.col(name).alias("finish"), "draw", "doc_id") <= F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["draw"]).alias("draw"), F.lit(last["doc_id"]).cast("long").alias("doc_id"))
            taken.append((at < over["slot"]) | ((at == over["slot"]) & inside))
    words = [F.when(F.col(n).isNotNull() & t, F.col("size")).otherwise(0) for n, t in zip(("finish_1", "finish_2"), taken, strict=True)]
    return timed.select(*carry, "doc_id", "source", "size", "source_size", "target", (words[0] + words[1]).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::BIGINT * 2.0::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM rows GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(most) OVER filling - most)) / (sum(weight) OVER () - (sum(weight) OVER filling - weight)) AS level
  FROM sources WINDOW filling AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
goals AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levels),
timed AS (
  SELECT r.doc_id, r.size, r.draw, g.source_size, g.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.draw, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT doc_id, draw, size, (words + k * source_size) / target AS finish, k
  FROM timed, (VALUES (0), (1)) AS p(k) WHERE size > 0 AND target > 0 AND words + k * source_size - size / 2.0::DOUBLE <= target),
taken AS (
  SELECT doc_id, draw, size, sum(size) OVER (ORDER BY finish, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS till FROM passes),
used AS (SELECT doc_id, count(*) AS n FROM taken WHERE till <= (SELECT 1.5::DOUBLE * sum(size) FROM rows) GROUP BY doc_id)
SELECT t.doc_id, t.size, t.source_size, t.target, (t.size * coalesce(u.n, 0))::BIGINT AS taken
FROM timed t LEFT JOIN used u ON t.doc_id = u.doc_id
"""
