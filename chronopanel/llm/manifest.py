"""Merkle manifest of a dataset in the layout of van Emde Boas.

Rows are leaves. Within a source they stand by doc_id, every three neighbours become one parent, and the roots of the
sources become one root in the same way. Aligned subtrees of six levels (729 leaves) are blocks: the digests of a block
are one array in which the upper half of its levels comes first and the subtrees below follow one after another, each
laid out so again. The place of a node follows from arithmetic alone, for building and for finding siblings. The roots
of the blocks are the leaves of the next layer, until each source has one root.

A place in the order of a source is a place within a range of rows plus the rows in the ranges before it, so a source
with a third of all rows is many ranges and many blocks. Every task holds one block. Texts are hashed where they are
read and never move. A proof descends from the root: a block hands each of its leaves the siblings inside the block
and those above it.

A null field is `-`; a null source is a source of its own and comes first; a null doc_id comes first in its source and
is not tampered with. Rows with one doc_id stand by their leaf digests, and equal rows are leaves of their own. An
empty text is `0:`. An empty table gives no rows and a manifest without blocks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, partitions, python_ready, staged

QUERY = "op13_merkle_manifest"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, HEIGHT = 3, 6
MET = ("tree", "block", "n", "height", "nodes", "path", "subroot")
BLOCKS = "tree string, block long, n int, height int, nodes binary, root binary, above long"


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree with that many levels."""
    return (RUN**levels - 1) // (RUN - 1)


def place(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` of one depth stand in the array of a tree: the tree is cut at half its levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return place(top, depth, index)
    width = RUN ** (depth - top)
    return nodes_of(top) + index // width * nodes_of(levels - top) + place(levels - top, depth - top, index % width)


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height_of(n: int) -> int:
    height = 0
    while RUN**height < n:
        height += 1
    return height


def built(leaves: list[bytes], height: int) -> bytes:
    """The array of one block; places of absent nodes are zero."""
    nodes, row = np.zeros((nodes_of(height + 1), 32), np.uint8), leaves
    for depth in range(height, -1, -1):
        nodes[place(height + 1, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        row = [parent(row[i : i + RUN]) for i in range(0, len(row), RUN)]
    return nodes.tobytes()


def rows_of(nodes: bytes, n: int, height: int) -> list[list[bytes]]:
    """The digests of each depth, from the leaves up to below the root."""
    table, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
    for depth in range(height, 0, -1):
        row = table[place(height + 1, depth, np.arange(n))].tobytes()
        out.append([row[i : i + 32] for i in range(0, len(row), 32)])
        n = -(-n // RUN)
    return out


def path_of(rows: list[list[bytes]], i: int) -> bytes:
    """Siblings of leaf i, level by level: own place in the run, their number, their digests."""
    out = []
    for row in rows:
        start = i - i % RUN
        run = row[start : start + RUN]
        out.append(bytes([i - start, len(run) - 1]) + b"".join(run[: i - start] + run[i - start + 1 :]))
        i //= RUN
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        yield own, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def proof_of(path: bytes) -> str:
    return hashlib.sha256("".join(s.hex() for _, others in steps(path) for s in others).encode()).hexdigest()


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings of its path lead to."""
    for own, others in steps(path):
        leaf = parent([*others[:own], leaf, *others[own:]])
    return leaf


def _field(column) -> F.Column:
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and the leaf after tampering of each row; nothing later reads the text."""
    text = F.col("text")
    digest = lambda body: F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(body)), 256))
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    rows = docs.select(*FIELDS).withColumn("leaf", digest(text)).withColumn("tampered", F.when(chosen, digest(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(F.col("leaf")))
    return rows.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("tree"), "doc_id", "leaf", "tampered")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """pos (from 0) of each row in its tree, and n, the rows of the tree."""
    ranges = partitions(rows.sparkSession)
    dealt = staged(rows.repartitionByRange(ranges, "tree", *order).withColumn("part", F.spark_partition_id()), "merkle-leaves")
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(W.partitionBy("tree")).alias("n"))
    within = F.row_number().over(W.partitionBy("tree", "part").orderBy(*order))
    numbered = dealt.withColumn("within", within).join(starts, ["tree", "part"])
    return numbered.withColumn("pos", F.col("start") + F.col("within") - 1).drop("part", "start", "within")


def layers(rows: DataFrame, most: int = HEIGHT) -> list[DataFrame]:
    """Blocks of (tree, pos, digest, n), layer by layer; `above` is the number of nodes in the layer above."""
    size, out = RUN**most, []

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n, table = table.column("n")[0].as_py(), table.sort_by("pos")
        height = most if n > size else height_of(n)
        nodes = built(table.column("digest").to_pylist(), height)
        kinds = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary()), ("above", pa.int64())])
        row = {"tree": key[0].as_py(), "block": key[1].as_py(), "n": len(table), "height": height, "nodes": nodes, "root": nodes[:32], "above": -(-n // size)}
        return pa.Table.from_pylist([row], kinds)

    while True:
        blocks = staged(rows.groupBy("tree", F.expr(f"pos div {size}").alias("block")).applyInArrow(block, BLOCKS), "merkle-blocks")
        out.append(blocks)
        if (blocks.agg(F.max("above")).first()[0] or 1) == 1:
            return out
        rows = blocks.filter("above > 1").select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), F.col("above").alias("n"))


def _below(blocks: DataFrame, most: int) -> DataFrame:
    """tree, block, path and subroot of each leaf of blocks that know the path of their own root."""
    size = RUN**most

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                rows, n = rows_of(b["nodes"], b["n"], b["height"]), b["n"]
                found = pa.array([path_of(rows, i) + b["path"] for i in range(n)], pa.binary())
                places = pa.array(np.arange(n, dtype=np.int64) + b["block"] * size)
                yield pa.RecordBatch.from_arrays([pa.array([b["tree"]] * n), places, found, pa.array([b["subroot"]] * n, pa.binary())], ["tree", "block", "path", "subroot"])

    return blocks.select(*MET).mapInArrow(descend, "tree string, block long, path binary, subroot binary")


def paths(stack: list[DataFrame], tops: DataFrame, most: int = HEIGHT) -> DataFrame:
    """The blocks of the lowest layer with the path of their roots; `tops` has tree, path and subroot of each tree."""
    met = None
    for blocks in reversed(stack):
        # few rows: one for each tree, or one for each block
        ended = blocks.filter("above = 1").join(tops, "tree").select(*MET)
        met = ended if met is None else ended.unionByName(blocks.filter("above > 1").join(_below(met, most), ["tree", "block"]).select(*MET))
    return met


@dataclass(frozen=True)
class Manifest:
    """The stored tables of a dataset: leaves with their places, blocks of every layer, the tree over the sources."""

    rows: DataFrame
    sources: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    root: bytes | None
    height: int


def manifest(docs: DataFrame, height: int = HEIGHT) -> Manifest:
    """`height` is the number of levels that a block has below its root."""
    python_ready(docs.sparkSession)
    rows = staged(placed(leaves(docs), "doc_id", "leaf"), "merkle-rows")
    sources = layers(rows.select("tree", "pos", F.col("leaf").alias("digest"), "n"), height)
    roots = reduce(DataFrame.unionByName, [b.filter("above = 1").select("tree", "root") for b in sources])
    # the order of the keys is the order of the sources: "n" for null, then "s" with the bytes of the name
    named = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    subroots = staged(placed(named, "name"), "merkle-subroots")
    over = layers(subroots.select("tree", "pos", "digest", "n"), height)
    top = over[-1].filter("above = 1").select("root").first()
    return Manifest(rows, sources, over, subroots, top and bytes(top[0]), height)


def proofs(m: Manifest) -> DataFrame:
    """One row for each leaf: its digests, its subroot, the path to the root, and the root that the tampered leaf gives."""
    none = F.lit(b"")
    start = m.rows.sparkSession.range(1).select(F.lit("").alias("tree"), none.alias("path"), none.alias("subroot"))
    above = _below(paths(m.over, start, m.height), m.height).select(F.col("block").alias("pos"), "path")
    tops = staged(m.subroots.join(above, "pos").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-tops")
    blocks, root, size = paths(m.sources, tops, m.height), m.root, RUN**m.height

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        b = right.to_pylist()[0]
        rows = rows_of(b["nodes"], b["n"], b["height"])
        whole = [path_of(rows, i % size) + b["path"] for i in left.column("pos").to_pylist()]
        fold = [folded(t, p) for t, p in zip(left.column("tampered").to_pylist(), whole, strict=True)]
        out = {"doc_id": left.column("doc_id"), "leaf": left.column("leaf"), "subroot": pa.array([b["subroot"]] * len(left), pa.binary())}
        return pa.table(out | {"path": pa.array(whole, pa.binary()), "proof": pa.array([proof_of(p) for p in whole]), "folded": pa.array(fold, pa.binary()), "verified": pa.array([f == root for f in fold])})

    dealt = m.rows.select("tree", "pos", "doc_id", "leaf", "tampered").withColumn("block", F.expr(f"pos div {size}"))
    kinds = "doc_id long, leaf binary, subroot binary, path binary, proof string, folded binary, verified boolean"
    return dealt.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(answer, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(documents(spark, sf_dir, *FIELDS))
    text = lambda c: F.lower(F.hex(c))
    return proofs(m).select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(m.root.hex() if m.root else None).cast("string").alias("root"),
        F.col("proof").alias("proof_sha256"), text("folded").alias("folded_root"), "verified",
    )


def _sql() -> str:
    """Levels are written out one by one, as many as sources of half a million rows need."""
    levels = range(13)
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    head = " || ".join(enc(c) for c in FIELDS[:-1])
    step = "CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    table = "SELECT b AS k, b::BIGINT AS x FROM range(256) r(b)"
    for _ in range(8):
        table = f"SELECT k, {step} AS x FROM ({table})"
    parts = [
        f"crc AS MATERIALIZED (SELECT list(x ORDER BY k) AS t FROM ({table}))",
        f"""d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, sha256({head} || {enc('text')}) AS leaf, CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda a, b: xor(a >> 8, t[(1 + (xor(a, b) & 255))::INTEGER])), 4294967295) % 2 = 0
    THEN sha256({head} || {enc("replace(text, chr(10), '')")}) ELSE sha256({head} || {enc('text')}) END AS tampered FROM documents, crc)""",
        "a0 AS MATERIALIZED (SELECT coalesce('s' || source, 'n') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, rid, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM d)",
    ]

    def climb(a: str) -> None:
        for k in levels:
            parts.append(f"{a}{k + 1} AS MATERIALIZED (SELECT tree, i // 3 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 2) // 3 AS n FROM (SELECT tree, i, h, n FROM {a}{k}) GROUP BY tree, n, i // 3)")

    climb("a")
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, tree AS name, h, count(*) OVER () AS n FROM a{len(levels)})")
    climb("b")
    for a in "ab":
        rows = " UNION ALL ".join(f"SELECT o.tree, o.i AS leaf_i, {k} AS k, s.i AS spot, s.h, s.i < o.i // {3**k} AS left_of FROM {a}0 o JOIN {a}{k} s ON s.tree = o.tree AND s.i // 3 = o.i // {3 ** (k + 1)} AND s.i <> o.i // {3**k}" for k in levels)
        parts.append(f"{a}_sides AS MATERIALIZED (SELECT tree, leaf_i, k, coalesce(string_agg(h, '' ORDER BY spot) FILTER (left_of), '') AS l, coalesce(string_agg(h, '' ORDER BY spot) FILTER (NOT left_of), '') AS r FROM ({rows}) GROUP BY ALL)")
        parts.append(f"{a}_proof AS MATERIALIZED (SELECT tree, leaf_i, string_agg(l || r, '' ORDER BY k) AS p FROM {a}_sides GROUP BY ALL)")
    # a run of one has no sibling but is hashed all the same, as long as its level has more than one node
    fold = "SELECT a0.rid, a0.tree, a0.i, d.tampered AS h FROM a0 JOIN d USING (rid)"
    for k in levels:
        parts.append(f"fa{k} AS MATERIALIZED (SELECT f.rid, f.tree, f.i, CASE WHEN m.n > 1 THEN sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) ELSE f.h END AS h FROM ({fold}) f JOIN (SELECT DISTINCT tree, n FROM a{k}) m ON m.tree = f.tree LEFT JOIN a_sides s ON s.tree = f.tree AND s.leaf_i = f.i AND s.k = {k})")
        fold = f"SELECT * FROM fa{k}"
    fold = f"SELECT f.rid, f.tree, b0.i, f.h FROM ({fold}) f JOIN b0 ON b0.name = f.tree"
    for k in levels:
        parts.append(f"fb{k} AS MATERIALIZED (SELECT f.rid, f.tree, f.i, CASE WHEN m.n > 1 THEN sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) ELSE f.h END AS h FROM ({fold}) f, (SELECT DISTINCT n FROM b{k}) m LEFT JOIN b_sides s ON s.leaf_i = f.i AND s.k = {k})")
        fold = f"SELECT * FROM fb{k}"
    end = len(levels)
    return f"""
WITH {", ".join(parts)}
SELECT d.doc_id, d.leaf, b0.h AS subroot, root.h AS root, sha256(coalesce(p.p, '') || coalesce(q.p, '')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM d JOIN a0 USING (rid) JOIN b0 ON b0.name = a0.tree LEFT JOIN a_proof p ON p.tree = a0.tree AND p.leaf_i = a0.i LEFT JOIN b_proof q ON q.leaf_i = b0.i JOIN ({fold}) f ON f.rid = d.rid, b{end} root
"""


SQL = _sql()
