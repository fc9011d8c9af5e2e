"""Hard negatives by rotated one-bit codes.

A vector is turned by a fixed random rotation and kept as the signs of its coordinates with its alignment, the length
of its projection on that code vector. What the code leaves is turned and coded again, so every vector has four codes,
four alignments and four residual lengths, in an eighth of its size. An anchor is turned in the same way and cut into
bit planes; popcounts of planes and codes give the product with every code vector. The error of the planes and the
Cauchy-Schwarz product of the residuals, both of them sure, make an interval around the estimate. Codes are read one
after another; a row is dropped as soon as its interval cannot reach what the wanted number of other rows reach for
certain, and the rows that are left are scored in integers.

Positives come from blocks of one label, negatives from blocks of all rows within the bands that the positives set.
A block of rows meets a block of anchors in one task, which emits at most the wanted number of rows for each anchor and
band. A label with a third of all rows is many blocks. No interval drops a row of the result: it is exact.

Rows with a null label or vector, or with a null or non-finite component, take no part; vectors of another length
never meet. A null vec_id takes part behind all others of its score, but is no anchor. Repeated rows are rows of their
own, also as anchors. Components are held to 2^53 after scaling and scores to 9 * 10^16, far beyond those of embeddings.
An empty table gives an empty result. Columns other than vec_id, label and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import python_ready, staged

QUERY = "op11_hard_negatives"
SCALE, EVERY, POSITIVES, NEGATIVES = 256.0, 50, 5, 3
LEVELS, PLANES = 4, 8
ROWS, ANCHORS = 8192, 1024  # of a block
COMPONENT, SCORE = 2.0**53, 9 * 10**16
CODED = "rid long, vec_id long, label long, dim int, v binary, bits binary, scale binary"


def turned(x: np.ndarray, level: int) -> np.ndarray:
    """Rows under the rotation of a level: random signs and a Walsh-Hadamard transform, twice."""
    n, d = x.shape
    for signs in np.random.default_rng(level).integers(0, 2, (2, d)) * 2.0 - 1.0:
        x, half = x * signs, 1
        while half < d:
            y = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            half *= 2
        x = x / np.sqrt(d)
    return x


def widened(v: np.ndarray) -> np.ndarray:
    """Zeros up to a power of two, 64 at least; no product changes."""
    d = 64
    while d < v.shape[1]:
        d *= 2
    return np.hstack([v.astype(np.float64), np.zeros((len(v), d - v.shape[1]))])


def _packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs, axis=-1, bitorder="little").view(np.uint64)


def coded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, levels, words) of signs, (rows, levels) of alignments and of residual lengths."""
    x, bits, align, rest = widened(v), [], [], []
    for level in range(LEVELS):
        x = turned(x, level)
        signs = x >= 0
        a = np.abs(x).mean(1)
        x = x - a[:, None] * np.where(signs, 1.0, -1.0)
        bits.append(_packed(signs)), align.append(a), rest.append(np.sqrt((x * x).sum(1)))
    return np.stack(bits, 1), np.stack(align, 1), np.stack(rest, 1)


class Anchor:
    """A vector as bit planes of every level: `dots` estimates its products with code vectors, `miss` bounds the error."""

    def __init__(self, v: np.ndarray):
        self.v, x = v.astype(np.float64), widened(v[None])
        self.length, self.planes, self.weights, self.start, self.miss = float(np.sqrt((x * x).sum())), [], [], [], []
        for level in range(LEVELS):
            x = turned(x, level)
            low = float(x.min())
            step = float(x.max() - low) / (2**PLANES - 1) or 1.0
            u = np.clip(np.round((x[0] - low) / step), 0, 2**PLANES - 1).astype(np.int64)
            planes = [(u >> b) & 1 == 1 for b in range(PLANES)] + [np.ones(len(u), bool)]
            self.planes.append(_packed(np.array(planes)))
            self.weights.append(np.repeat([*[2.0 * step * 2**b for b in range(PLANES)], 2.0 * low], self.planes[-1].shape[1]))
            self.start.append(-step * float(u.sum()) - low * len(u))
            self.miss.append(float(np.abs(x[0] - low - step * u).sum()))

    def dots(self, bits: np.ndarray, level: int) -> np.ndarray:
        counts = np.bitwise_count(bits[:, None, :] & self.planes[level])
        return counts.reshape(len(bits), -1).astype(np.float64) @ self.weights[level] + self.start[level]


class Block:
    """Vectors of one length with their codes."""

    def __init__(self, table: pa.Table):
        self.rid, self.vec_id = table.column("rid").to_numpy(), table.column("vec_id").to_pylist()
        self.order = np.array([np.iinfo(np.int64).max if i is None else i for i in self.vec_id], np.int64)
        self.label, n = table.column("label").to_numpy(), len(table)
        self.v = np.stack(_vectors(table)) if n else np.zeros((0, 0))
        self.most = float(np.abs(self.v).max(initial=0.0))
        self.bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(n, LEVELS, -1).transpose(1, 0, 2).copy()
        scale = np.frombuffer(b"".join(table.column("scale").to_pylist()), np.float64).reshape(n, 2, LEVELS)
        self.align, self.rest = scale[:, 0].T.copy(), scale[:, 1].T.copy()
        self.length = np.sqrt(self.rest[0] ** 2 + self.align[0] ** 2 * self.bits.shape[2] * 64)

    def scores(self, rows: np.ndarray, a: Anchor) -> np.ndarray:
        """Integer products; beyond what doubles hold exactly, in Python's integers."""
        if self.most * float(np.abs(a.v).max(initial=0.0)) * max(1, len(a.v)) < 2**53:
            return (self.v[rows].astype(np.float64) @ a.v).astype(np.int64)
        own = [int(x) for x in a.v]
        return np.array([max(-SCORE, min(SCORE, sum(int(x) * y for x, y in zip(row, own, strict=True)))) for row in self.v[rows]], np.int64)

    def best(self, a: Anchor, rows: np.ndarray, bands: list[tuple[int, int]], wanted: int) -> Iterator[tuple[int, int, int]]:
        """(band, row, score) of the `wanted` highest scores within each band, ties by vec_id, among some rows."""
        d, estimate, miss = self.bits.shape[2] * 64, np.zeros(len(rows)), np.zeros(len(rows))
        for level in range(LEVELS):
            if len(rows) <= 2 * wanted:
                break
            dots, align = a.dots(self.bits[level][rows], level), self.align[level][rows]
            estimate, miss = estimate + align * dots, miss + align * a.miss[level]
            along = np.maximum(np.abs(dots) - a.miss[level], 0.0)
            apart = np.sqrt(np.maximum(a.length**2 - along**2 / d, 0.0)) * self.rest[level][rows]
            width = miss + apart + 1e-9 * (1.0 + a.length * self.length[rows])
            low, high = np.clip(estimate - width, -SCORE, SCORE), np.clip(estimate + width, -SCORE, SCORE)
            keep = np.zeros(len(rows), bool)
            for first, last in bands:
                sure = low[(low >= first) & (high <= last)]
                least = np.partition(sure, len(sure) - wanted)[len(sure) - wanted] if len(sure) >= wanted else first
                keep |= (high >= max(first, least)) & (low <= last)
            rows, estimate, miss = rows[keep], estimate[keep], miss[keep]
        scores = self.scores(rows, a)
        for k, (first, last) in enumerate(bands):
            inside = np.flatnonzero((scores >= first) & (scores <= last))
            for i in inside[np.lexsort([self.rid[rows[inside]], self.order[rows[inside]], -scores[inside]])[:wanted]].tolist():
                yield k, int(rows[i]), int(scores[i])


def _vectors(table: pa.Table) -> list[np.ndarray]:
    kinds = {2: np.int16, 4: np.int32, 8: np.float64}
    return [np.frombuffer(b, kinds[len(b) // d] if d else np.int16) for b, d in zip(table.column("v").to_pylist(), table.column("dim").to_pylist(), strict=True)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integer components in the narrowest type that holds a batch, and codes."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.array([len(v) for v in batch.column("embedding").to_pylist()], np.int64)
        for d in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == d)).combine_chunks()
            flat = part.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(flat * SCALE), -COMPONENT, COMPONENT).reshape(len(part), d)
            most = np.abs(v).max(initial=0.0)
            v = v.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)
            bits, align, rest = coded(v)
            scale = np.stack([align, rest], 1)
            blobs = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (v, bits, scale)]
            columns = [part.column(c).combine_chunks() for c in ("rid", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(part), d, np.int32)), *blobs], CODED.replace(",", "").split()[::2])


def rows_with_codes(vectors: DataFrame) -> DataFrame:
    value, label = F.col("embedding"), F.col("label").cast("long")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = label.isNotNull() & value.isNotNull() & ~bad
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.select("vec_id", "label", "embedding").filter(sound).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    return staged(rows.mapInArrow(_coded, CODED), "negatives-codes")


def _dealt(df: DataFrame, own: str, n: F.Column, other: str, m: F.Column) -> DataFrame:
    """Rows under the number of their own block, once for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64("rid"), n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))


def _parts(count, size: int) -> F.Column:
    return F.ceil(count / size).cast("long")


def positives(rows: DataFrame, anchors: DataFrame, block: tuple[int, int]) -> DataFrame:
    """The first rows of the label of each anchor: anchor, slot (from 0), positive_id and positive_score."""
    sizes = staged(rows.groupBy(F.col("label").alias("of"), F.col("dim").alias("long_of")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % EVERY == 0).alias("m")).filter("m > 0"), "negatives-labels")
    met = lambda df: df.join(sizes, (F.col("label") == F.col("of")) & (F.col("dim") == F.col("long_of")))
    n, m, keys = _parts(F.col("n"), block[0]), _parts(F.col("m"), block[1]), ["label", "dim", "r", "a"]

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], ("anchor", "id", "other", "score"))
        out, mine = [], Block(left)
        for rid, v in zip(right.column("rid").to_pylist(), _vectors(right), strict=True):
            others = np.flatnonzero(mine.rid != rid)
            out += [(rid, mine.vec_id[i], int(mine.rid[i]), s) for _, i, s in mine.best(Anchor(v), others, [(-SCORE, SCORE)], POSITIVES)]
        return _table(out, ("anchor", "id", "other", "score"))

    left, right = (df.select(*rows.columns, "r", "a") for df in (_dealt(met(rows), "r", n, "a", m), _dealt(met(anchors), "a", m, "r", n)))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, "anchor long, id long, other long, score long")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "other")) - 1
    return near.withColumn("slot", place).filter(F.col("slot") < POSITIVES).select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)})


def band(positive: int) -> tuple[int, int]:
    """Scores from half of a positive's to 95 hundredths of it; empty below zero."""
    return -(-positive // 2), positive * 95 // 100


def mined(vectors: DataFrame, block: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    python_ready(vectors.sparkSession, 4096)
    rows = rows_with_codes(vectors)
    anchors = staged(rows.filter(F.col("vec_id") % EVERY == 0), "negatives-anchors")
    near = staged(positives(rows, anchors, block), "negatives-positives")
    slots = near.groupBy(F.col("anchor").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("slots"))
    asked = staged(anchors.join(slots, "rid"), "negatives-asked")
    n, m = (F.lit(max(1, -(-df.count() // size))).cast("long") for df, size in zip((rows, asked), block, strict=True))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _table([], ("anchor", "slot", "id", "other", "score"))
        out, mine = [], Block(left)
        for rid, label, slots, v in zip(right.column("rid").to_pylist(), right.column("label").to_pylist(), right.column("slots").to_pylist(), _vectors(right), strict=True):
            others, bands = np.flatnonzero(mine.label != label), [band(s["positive_score"]) for s in slots]
            out += [(rid, slots[k]["slot"], mine.vec_id[i], int(mine.rid[i]), s) for k, i, s in mine.best(Anchor(v), others, bands, NEGATIVES)]
        return _table(out, ("anchor", "slot", "id", "other", "score"))

    keys = ["dim", "r", "a"]
    far = _dealt(rows, "r", n, "a", m).groupBy(*keys).cogroup(_dealt(asked, "a", m, "r", n).groupBy(*keys)).applyInArrow(found, "anchor long, slot long, id long, other long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "other"))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    named = near.join(asked.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return far.join(named, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.rid <> b.rid AND len(a.e) = len(b.e)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, other) AS slot FROM s WHERE same QUALIFY slot <= {POSITIVES})
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.slot ORDER BY s.score DESC, s.id NULLS LAST, s.other)::INTEGER AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= {NEGATIVES}
"""
