"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link at 3 or fewer differing bits. The word is cut in the middle: of 3 differing bits
one half has at most 1, which is half the radius rounded down. So every fingerprint emits, for each half, all variants
of that half within one bit (33), the variants are shuffled, and whatever meets on a half that one of them owns is
verified on the whole word. (Balls on the uncut word must reach radius 2 on one side: 2,081 rows a fingerprint
instead of 66.) Documents with one fingerprint are one node. Where many fingerprints meet on one half, they are dealt
into blocks and the pairs of blocks are tasks of their own; each emits a spanning forest of its links, never all pairs.

A null text is empty and has fingerprint zero, which links like any other. Repeated rows are documents of their own. A
null doc_id takes part but is never the smallest unless it is alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clusters import components
from .common import documents, partitions, python_ready, staged
from .textarrays import slices, words

QUERY = "op4_simhash"
SQL = None
RADIUS, SHINGLE, SEED = 3, 3, 42
SLICE = 250_000  # bytes of text a worker unfolds at once; the bits of their shingles take some hundred times that
BLOCK = 2048  # fingerprints of one half value that one task compares with as many others
_U = np.uint64
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (_U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _round(acc, lane):
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of data[start:start + length] for all parts at once."""
    room = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    four = np.ndarray((len(room) - 3,), "<u4", room, strides=(1,))
    seed, at = _U(seed), starts.astype(np.int64).copy()
    h = np.full(len(starts), seed + P5, np.uint64)
    long = np.flatnonzero(lengths >= 32)
    if len(long):
        acc = [np.full(len(long), v % 2**64, np.uint64) for v in (int(seed) + int(P1) + int(P2), int(seed) + int(P2), int(seed), int(seed) - int(P1))]
        stripes = lengths[long] // 32
        live = np.arange(len(long))
        for s in range(int(stripes.max())):
            live = live[stripes[live] > s]
            where = starts[long[live]] + 32 * s
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[where + 8 * k])
        joined = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for v in acc:
            joined = (joined ^ _round(_U(0), v)) * P1 + P4
        h[long] = joined
        at[long] += 32 * stripes
    h += lengths.astype(np.uint64)
    rest = lengths % 32
    for k in range(1, 4):
        some = np.flatnonzero(rest >= 8 * k)
        h[some] = _turn(h[some] ^ _round(_U(0), eight[at[some]]), 27) * P1 + P4
        at[some] += 8
    rest %= 8
    some = np.flatnonzero(rest >= 4)
    h[some] = _turn(h[some] ^ (four[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
    at[some] += 4
    rest %= 4
    for k in range(1, 4):
        some = np.flatnonzero(rest >= k)
        h[some] = _turn(h[some] ^ (room[at[some]].astype(np.uint64) * P5), 11) * P1
        at[some] += 1
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    return h ^ (h >> _U(32))


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint a document."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, n = words(data, offsets)
    out = np.zeros(len(n), np.uint64)
    if len(starts) == 0:
        return out
    length = ends - starts
    joined = np.full(int(length.sum()) + len(length), 32, np.uint8)  # words with one space after each
    begin = np.cumsum(length + 1) - (length + 1)
    shift = np.repeat(begin - starts, length)
    inside = np.arange(len(shift)) - np.repeat(np.cumsum(length) - length - starts, length)
    joined[inside + shift] = data[inside]
    m = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    full = np.flatnonzero(m)
    heads = np.cumsum(m[full]) - m[full]
    first = np.arange(int(m.sum())) - np.repeat(heads, m[full]) + np.repeat((np.cumsum(n) - n)[full], m[full])
    last = first + np.repeat(np.minimum(n[full], shingle) - 1, m[full])
    h = xxh64(joined, begin[first], begin[last] + length[last] - begin[first])
    ones = np.empty((len(full), 64), np.int64)
    for i, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):  # eight bits at a time: reduceat copies what it sums to its type
        bits = np.unpackbits(np.ascontiguousarray(byte)[:, None], axis=1, bitorder="little")
        ones[:, 8 * i : 8 * i + 8] = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > m[full][:, None], axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64).ravel()
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text", SLICE):
        keep = [rows.column(c) for c in rows.schema.names if c != "text"]
        names = [c for c in rows.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(fingerprints(data, offsets).view(np.int64))], [*names, "fp"])


def _forest(fp: np.ndarray, own: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among a few thousand fingerprints of which one at least owns the half."""
    a, b, left = [], [], np.ones(len(fp), bool)
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            i = front.pop()
            near = left & (np.bitwise_count(fp ^ fp[i]) <= RADIUS)
            if not own[i]:
                near &= own
            for j in np.flatnonzero(near).tolist():
                a.append(i), b.append(j), front.append(j)
            left &= ~near
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, fp, own) sorted by tile to links (a, b); small tiles of a batch are compared together."""
    held: list[np.ndarray] = []

    def links(tile, fp, own):
        edge = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
        small, out_a, out_b = np.repeat(np.diff(edge) <= 16, np.diff(edge)), [], []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            if j - i > 16:
                a, b = _forest(fp[i:j], own[i:j])
                out_a.append(fp[i:j][a]), out_b.append(fp[i:j][b])
        t, f, o = tile[small], fp[small], own[small]
        for s in range(1, 16):
            pair = (t[s:] == t[:-s]) & (o[s:] | o[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= RADIUS)
            out_a.append(f[:-s][pair]), out_b.append(f[s:][pair])
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        now = [np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("tile", "fp", "own")]
        if len(now[0]) == 0:
            continue
        now[1] = now[1].view(np.uint64)
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        whole = int(np.searchsorted(np.flip(held[0] != held[0][-1]), True))  # rows of the last tile wait for more
        cut = len(held[0]) - whole
        if cut:
            yield links(*[x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held:
        yield links(*held)


def candidate_tiles(nodes: DataFrame) -> DataFrame:
    """(tile, fp, own): distinct fingerprints dealt by the half values they own or come within one bit of.

    Spark sizes the 66 rows of a fingerprint like the one row they come from, so the join is told not to broadcast."""
    halves = {0: F.col("fp").bitwiseAND(0xFFFFFFFF), 1: F.shiftrightunsigned("fp", 32)}
    ball = F.array(*[F.struct((F.lit(h << 32) + v.bitwiseXOR(F.lit(0 if b < 0 else 1 << b).cast("long"))).alias("key"), F.lit(b < 0).alias("own")) for h, v in halves.items() for b in range(-1, 32)])
    rows = nodes.select("fp", F.explode(ball).alias("v")).select("fp", "v.key", "v.own")
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).filter("owned AND n > 1").select(F.col("key").alias("met"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.hint("merge").join(met, F.col("key") == F.col("met")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("mine")).alias("i"), F.greatest(i, F.col("mine")).alias("j"))))
    return dealt.select("fp", "own", "key", pair.alias("at")).select(F.xxhash64("key", "at.i", "at.j").alias("tile"), "fp", "own")


def linked(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns, fp and `first` (the smallest doc_id of the component) of each row."""
    spark = docs.sparkSession
    python_ready(spark)
    kinds = docs.select(*carry, "doc_id", "text").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds if f.name != "text") + ", fp long"
    rows = staged(docs.select(*carry, "doc_id", "text").mapInArrow(_fingerprint_rows, schema), "simhash-rows")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    tiles = candidate_tiles(nodes).repartition(partitions(spark), "tile").sortWithinPartitions("tile", "fp")
    edges = staged(tiles.mapInArrow(_links, "a long, b long").distinct(), "simhash-links")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    groups = components(ends, edges)
    label = staged(nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-groups")
    smallest = label.groupBy("label").agg(F.min("first").alias("smallest"))
    named = label.select("fp", "label").join(smallest, "label").select(F.col("fp").alias("of"), "smallest")
    return rows.join(named, F.col("fp") == F.col("of")).drop("of").withColumnRenamed("smallest", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-copies: the first row of each component, in order of doc_id, stays."""
    numbered = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "simhash-numbered")
    found = linked(numbered.select("rid", "row.doc_id", "row.text"), "rid")
    kept = found.groupBy(F.coalesce("component_id", F.lit(-1)).alias("g"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("m")).select("m.rid")
    gone = found.select("rid").join(kept, "rid", "left_anti")  # fewer than what stays
    return numbered.join(gone, "rid", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
