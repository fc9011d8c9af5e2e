"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of a label are one class. Unit vectors are turned to their principal axes, which changes no product, and
each label is cut into tiles of neighbours along the first axis. Two tiles meet if their first coordinates come close
enough for the threshold, and every such pair of tiles is a task of its own: it adds up the products of the leading
axes first, bounds the rest by the norms of the remaining axes, drops rows that cannot reach the threshold, and stops
when none is left. A task emits link counts of its rows and a spanning forest of their links, never all pairs. A label
with a third of all rows is many tiles.

Vectors of another label or length never meet. A vector without label, with a null or non-finite component, or of
length zero links with nothing. Repeated rows are vectors of their own and link with each other. A null vec_id takes
part; its component is the smallest vec_id there is among those it reaches. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import components
from .common import partitions, python_ready, staged

QUERY = "op3_embedding_tiles"
THRESHOLD, TILE = 0.98, 1024
LEADING = (8, 16, 32)


def _unit(column) -> list[np.ndarray]:
    out = []
    for v in column.to_pylist():
        v = np.array(v, np.float64)
        out.append(v / np.sqrt(np.dot(v, v)))
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a batch of unit vectors, by length: their number, their sum and the sum of their products."""
    for batch in batches:
        by_length: dict[int, list[np.ndarray]] = {}
        for v in _unit(batch.column("embedding")):
            by_length.setdefault(len(v), []).append(np.append(v, 1.0))
        for d, rows in by_length.items():
            m = np.stack(rows)
            yield _sum_rows(d, m.T @ m)


def _sum_rows(d: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.ravel())], ["dim", "at", "value"])


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each length of vector: the driver gets one sum for each pair of coordinates."""
    out = {}
    sums = classes.select("embedding").mapInArrow(_moments, "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).toArrow().to_pandas()
    for d, part in sums.groupby("dim"):
        m = np.zeros((d + 1) ** 2)
        m[part["at"].to_numpy()] = part["value"].to_numpy()
        m = m.reshape(d + 1, d + 1)
        mean = m[:d, d] / m[d, d]
        _, vectors = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        out[int(d)] = np.ascontiguousarray(vectors[:, ::-1])
    return out


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of a symmetric matrix of links."""
    a, b, left = [], [], near.any(1)
    for root in np.flatnonzero(left).tolist():
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            a.extend([i] * len(new)), b.extend(new.tolist()), front.extend(new.tolist())
    return a, b


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, leading=LEADING) -> np.ndarray:
    """Which rows of x and y have a product of the threshold or more; coordinates are in the order of the axes."""
    near = np.zeros((len(x), len(y)), bool)
    i, j, done = np.arange(len(x)), np.arange(len(y)), 0
    part = np.zeros((len(x), len(y)))
    for stop in [*[k for k in leading if k < x.shape[1]], x.shape[1]]:
        part = part + x[i, done:stop] @ y[j, done:stop].T
        rest = np.outer(np.sqrt((x[i, stop:] ** 2).sum(1)), np.sqrt((y[j, stop:] ** 2).sum(1)))
        alive = part + rest >= (threshold - 1e-9 if stop < x.shape[1] else threshold)
        rows, columns = alive.any(1), alive.any(0)
        if not rows.any():
            return near
        if stop == x.shape[1]:
            near[np.ix_(i, j)] = alive
            return near
        i, j, part, done = i[rows], j[columns], part[np.ix_(rows, columns)], stop
    return near


def linked(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    spark = vectors.sparkSession
    python_ready(spark)
    value = F.col("embedding")
    bad = F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & value.isNotNull() & ~bad & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = staged(vectors.select("vec_id", "label", "embedding", sound.alias("sound")).withColumn("class", F.when(F.col("sound"), F.xxhash64("label", "embedding"))), "vectors")
    classes = staged(rows.filter("sound").groupBy("class", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "vector-classes")
    turn = spark.sparkContext.broadcast(axes(classes))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [v @ turn.value[len(v)] for v in _unit(batch.column("embedding"))]
            columns = [batch.column("class"), batch.column("label").cast(pa.string()), pa.array([len(v) for v in z], pa.int32()), batch.column("n"), pa.array([float(v[0]) for v in z]), pa.array([v.tobytes() for v in z], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "label", "dim", "n", "lead", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, owner, size = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            names = []
            for key in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                if key != owner or size == tile:
                    name, owner, size = name + 1, key, 0
                size += 1
                names.append(name)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, "tile"])

    kinds = "class long, label string, dim int, n long, lead double, z binary"
    ordered = classes.select("class", "label", "n", "embedding").mapInArrow(turned, kinds).repartitionByRange(partitions(spark), "label", "dim", "lead", "class").sortWithinPartitions("label", "dim", "lead", "class")
    tiles = staged(ordered.mapInArrow(cut, kinds + ", tile long"), "vector-tiles")
    reach = float(np.sqrt(2 - 2 * threshold) + 1e-9)
    span = staged(tiles.groupBy("label", "dim", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high")), "vector-spans")
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col("low") / reach) - low, F.floor(F.col("high") / reach) + high)).alias("cell")
    one = span.select("label", "dim", "tile", "low", "high", cells(0, 0))
    two = span.select("label", "dim", F.col("tile").alias("tile_2"), F.col("low").alias("low_2"), F.col("high").alias("high_2"), cells(1, 1))
    close = (F.col("low") - F.col("high_2") <= reach) & (F.col("low_2") - F.col("high") <= reach)
    met = one.join(two, ["label", "dim", "cell"]).filter(close).select(F.least("tile", "tile_2").alias("i"), F.greatest("tile", "tile_2").alias("j")).distinct()
    sides = met.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("side"))
    dealt = tiles.select("tile", "class", "n", "z").join(sides, F.col("tile") == F.col("side")).select("i", "j", "tile", "class", "n", "z")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        z = np.stack([np.frombuffer(b, np.float64) for b in table.column("z").to_pylist()])
        name, n, of = (table.column(c).to_numpy() for c in ("class", "n", "tile"))
        mine = of == table.column("i")[0].as_py()
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            near = close_pairs(z, z, threshold)
            near = near | near.T
            np.fill_diagonal(near, False)
        else:
            half = close_pairs(z[mine], z[~mine], threshold)
            near = np.zeros((len(z), len(z)), bool)
            near[np.ix_(mine, ~mine)] = half
            near[np.ix_(~mine, mine)] = half.T
        links = near @ n
        some = np.flatnonzero(links)
        a, b = _forest(near)
        return pa.table({"a": np.concatenate([name[some], name[a]]).astype(np.int64), "b": np.concatenate([name[some], name[b]]).astype(np.int64), "links": np.concatenate([links[some], np.zeros(len(a), np.int64)]).astype(np.int64)})

    found = staged(dealt.groupBy("i", "j").applyInArrow(compare, "a long, b long, links long"), "vector-links")
    counts = found.filter("a = b").groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    edges = found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    groups = components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)
    named = classes.select("class", "first", "n").join(groups, F.col("class") == F.col("node"), "left").select("class", "first", "n", F.coalesce("label", "class").alias("group")).join(counts, F.col("class") == F.col("of"), "left")
    named = staged(named.select("class", "first", "group", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-groups")
    smallest = named.groupBy("group").agg(F.min("first").alias("smallest"))
    answer = named.join(smallest, "group").select(F.col("class").alias("of"), "n_links", "smallest")
    joined = rows.join(answer, F.col("class") == F.col("of"), "left")
    component = F.when(F.col("sound"), F.col("smallest")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = f"""
WITH RECURSIVE every AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
v AS MATERIALIZED (
  SELECT rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM every
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT rid AS a, rid AS b FROM every UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least_of AS (SELECT r.a AS rid, min(x.vec_id) AS component_id FROM reach r JOIN every x ON x.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM every LEFT JOIN n USING (rid) LEFT JOIN least_of USING (rid)
"""
