"""Meeting of all texts that share a window of W symbols, by blocks of documents and parts of a key space.

A window's anchor is the least hash among its runs of `k` symbols, so equal windows have equal anchors. Neighbouring
windows of a document with one anchor are a unit. Blocks of some megabytes of documents travel as single rows:

1. each block sends the anchors it holds, with their counts, to the parts of the anchors' hashes; a part answers how
   often each occurs in the corpus;
2. each block sends its units under anchors that occur again, equal units of the block once, to the parts; a part has
   all units of its anchors, builds an index over them a shard at a time, and answers for each window of each unit;
3. each block applies the answers to its documents.

An anchor of very many units is cut: its units are dealt by their hash, and each pair of deals is a key of its own, so
that every two units still meet and no task gets them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, python_ready, text_or_empty
from .textarrays import mixed, texts

BLOCK = 4_000_000  # bytes of text in a block
ROWS_OF_BLOCK = 20_000
PIECE = 200_000  # bytes of text whose hashes are in memory at once
ROWS = "kind int, block long, part int, ids array<long>, blob binary"
LAST = np.iinfo(np.int64).max  # in place of a null doc_id
_U = np.uint64
_LOW = _U(0xFFFFFF)
TEXT, ASK, TOLD, UNIT, MARK = range(5)


@dataclass(frozen=True)
class Method:
    """What differs between the operators. `symbols` makes (hash of each symbol, value of each symbol, bounds of the
    documents) from (bytes, offsets). A unit's weight is its smallest doc_id (`by_doc`) or how often it occurs. `index`
    answers for a shard of units
    (values, lengths, weights) with one number a window. `alone` gives the number for all windows of a unit that meets no
    other (by its weight), or -1 where the unit may repeat itself and must be looked up."""

    window: int
    run: int
    symbols: Callable
    value: type
    answer: type
    by_doc: bool
    index: Callable
    alone: Callable
    shard: int
    crowd: int = 20_000


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds), 8), 8 + 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of 64-bit values by their place in the value: sorted values pack well so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T)


def unplanes(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(8, -1).T).view(np.uint64).ravel()


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., first + n - 1 for each entry, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first, n)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours, by doubling: a polynomial over the symbols' hashes, mixed at the end."""
    factor, power, length, out = 0x9E3779B97F4A7C15, hashes, 1, None
    done = 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out = power
            else:
                n = len(hashes) - done - length + 1
                out = out[: max(n, 0)] * _U(pow(factor, length, 2**64)) + power[done : done + max(n, 0)]
            done += length
        rest >>= 1
        if rest:
            n = max(len(power) - length, 0)
            power = power[:n] * _U(pow(factor, length, 2**64)) + power[length : length + n]
            length *= 2
    return mixed(out)


def least_of(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    out, s = values, 1
    while 2 * s <= w:
        out = np.minimum(out[:-s], out[s:])
        s *= 2
    return np.minimum(out[: len(out) - (w - s)], out[w - s :]) if w > s else out


def find_units(hashes: np.ndarray, bounds: np.ndarray, window: int, run: int):
    """(first symbol, number of windows, anchor, times the anchor occurs) of all units of some documents."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, np.zeros(0, np.uint64), none
    n = np.diff(bounds) - window + 1
    full = n > 0
    if not full.any():
        return none, none, np.zeros(0, np.uint64), none
    w, g = window - run + 1, run_hashes(hashes, run)
    at = spans(bounds[:-1][full], n[full])  # first symbols of the windows that lie in one document
    # the least hash with its first place in the window, in one number: 40 bits of hash, 24 of place
    place = np.arange(len(g), dtype=np.uint64) & _LOW
    first_place = (least_of((g & ~_LOW) | place, w)[at] & _LOW).astype(np.int64)
    first_place = at + ((first_place - at) & int(_LOW))
    value = g[first_place]
    head = np.zeros(len(at), bool)
    head[np.cumsum(n[full]) - n[full]] = True
    head[1:] |= value[1:] != value[:-1]
    starts = np.flatnonzero(head)
    count = np.diff(np.append(starts, len(at)))
    # equal windows of one unit have their first places as far apart as they are themselves
    twice = np.minimum.reduceat(first_place, starts) != np.maximum.reduceat(first_place, starts)
    if count.max() > w:  # a part of the text repeats itself: cut into units of bounded length
        pieces = -(-count // w)
        k = spans(np.zeros(len(count), np.int64), pieces)
        starts, count, twice = np.repeat(starts, pieces) + k * w, np.minimum(w, np.repeat(count, pieces) - k * w), np.repeat(twice, pieces)
    return at[starts], count, value[starts], 1 + twice.astype(np.int64)


class Block:
    """The documents of a block; its units are found again from the texts whenever they are needed."""

    def __init__(self, ids: np.ndarray, column, method: Method):
        self.ids, self.method = ids, method
        self.data, self.offsets = texts(column)

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, bytes, offsets) of parts of the block."""
        i = 0
        while i < len(self.ids):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + PIECE, "right")) - 1)
            yield i, self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i]
            i = j

    def units(self):
        """(values of all symbols, bounds of the documents, first, windows, anchor, times) over the block."""
        values, bounds, rows, base = [], [np.zeros(1, np.int64)], [], 0
        for _, data, offsets in self.pieces():
            hashes, value, edges = self.method.symbols(data, offsets)
            first, count, anchor, times = find_units(hashes, edges, self.method.window, self.method.run)
            rows.append((first + base, count, anchor, times))
            values.append(value), bounds.append(edges[1:] + base)
            base += len(value)
        first, count, anchor, times = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        return np.concatenate(values) if values else np.zeros(0, self.method.value), np.concatenate(bounds), first, count, anchor, times


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, pa.Array]]:
    """(name, doc_ids, texts) of some megabytes each; the name is a hash of both, the same at every reading."""
    def named(held):
        ids, column = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
        data, offsets = texts(column)
        digest = hashlib.blake2b(np.ascontiguousarray(data), digest_size=8)
        digest.update(offsets.tobytes() + repr(ids.to_pylist()).encode())
        return int.from_bytes(digest.digest(), "little", signed=True), ids.to_pylist(), column

    held, size, rows = [], 0, 0
    for batch in batches:
        _, offsets = texts(batch.column("text"))
        i = 0
        while i < batch.num_rows:
            fits = int(np.searchsorted(offsets, offsets[i] + BLOCK - size, "right")) - 1
            j = max(i + 1, min(batch.num_rows, fits, i + ROWS_OF_BLOCK - rows))
            held.append((batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i)))
            size, rows = size + int(offsets[j] - offsets[i]), rows + j - i
            i = j
            if size >= BLOCK or rows >= ROWS_OF_BLOCK or i < batch.num_rows:
                yield named(held)
                held, size, rows = [], 0, 0
    if held:
        yield named(held)


def _row(kind: int, block: int, part: int, ids, blob: bytes) -> pa.RecordBatch:
    fields = [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(fields, ["kind", "block", "part", "ids", "blob"])


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(rows or [_row(0, 0, 0, None, b"").slice(0, 0)])


def _asked(anchor: np.ndarray, times: np.ndarray, parts: int):
    """Distinct anchors of a block in the order (part, anchor), their counts, and the bounds of the parts."""
    known, inverse = np.unique(anchor, return_inverse=True)
    count = np.bincount(inverse, times, len(known)).astype(np.int64)
    part = (mixed(known) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return known[order], count[order], np.searchsorted(part[order], np.arange(parts + 1))


def meet(docs: DataFrame, method: Method, finish: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """finish(block, first, count, answers) gives the rows of one block as an Arrow table: `answers`
    has, for each unit occurrence in turn, one number for each of its `count` windows."""
    spark = docs.sparkSession
    python_ready(spark)
    parts = parts or 2 * partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def texts_of_blocks(batches):
        for block, ids, column in blocks_of(batches):
            data, offsets = texts(column)
            yield _row(TEXT, block, -1, ids, pack(np.ascontiguousarray(data), offsets))

    def anchors_of_blocks(batches):
        for block, ids, column in blocks_of(batches):
            *_, anchor, times = Block(np.array(ids, object), column, method).units()
            known, count, edges = _asked(anchor, times, parts)
            for p in np.flatnonzero(np.diff(edges)).tolist():
                mine = slice(edges[p], edges[p + 1])
                yield _row(ASK, block, p, None, pack(planes(known[mine]), count[mine].astype(np.uint32)))

    def counted(table: pa.Table) -> pa.Table:
        """How many deals each anchor needs; 0 if it occurs once in the corpus."""
        rows = [unpack(b, np.uint8, np.uint32) for b in table.column("blob").to_pylist()]
        anchors = [unplanes(r[0]) for r in rows]
        known, inverse = np.unique(np.concatenate(anchors), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([r[1] for r in rows]), len(known)).astype(np.int64)
        deals = np.where(total > 1, -(-total // method.crowd), 0)[inverse].astype(np.uint32)
        edges = np.cumsum([0, *[len(a) for a in anchors]])
        blocks, part = table.column("block").to_pylist(), table.column("part").to_pylist()
        return _table([_row(TOLD, b, p, None, pack(deals[i:j])) for b, p, i, j in zip(blocks, part, edges[:-1], edges[1:], strict=True)])

    def block_in(rows: list[dict]) -> tuple[Block, int]:
        own = [r for r in rows if r["kind"] == TEXT]
        if not own:
            raise ValueError("answers came back for a block that is not there")
        data, offsets = unpack(own[0]["blob"], np.uint8, np.int64)
        column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return Block(np.array(own[0]["ids"], object), column, method), len(own)

    def chosen(rows: list[dict]):
        """The units of a block under anchors that occur again: equal ones once, and the entries to send by part."""
        block, copies = block_in(rows)
        values, bounds, first, count, anchor, times = block.units()
        known, _, edges = _asked(anchor, times, parts)
        deals, told = np.zeros(len(known), np.int64), {r["part"]: r["blob"] for r in rows if r["kind"] == TOLD}
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if p not in told:
                raise ValueError("a block came back without the counts of some of its anchors")
            deals[edges[p] : edges[p + 1]] = unpack(told[p], np.uint32)[0]
        order = np.argsort(known)
        cuts = deals[order][np.searchsorted(known[order], anchor)]
        some = np.flatnonzero(cuts)
        first, count, anchor, cuts = first[some], count[some], anchor[some], cuts[some]
        name_of = _content(values, first, count + method.window - 1)
        distinct, rep, which = np.unique(mixed(name_of ^ mixed(anchor)), return_index=True, return_inverse=True)
        # one entry for each unit and deal: the pair of deals is part of the key
        n = cuts[rep]
        unit = np.repeat(np.arange(len(distinct)), n)
        other, mine = spans(np.zeros(len(n), np.int64), n), (name_of[rep][unit] % n[unit].astype(np.uint64)).astype(np.int64)
        key = mixed(anchor[rep][unit] ^ mixed((np.minimum(other, mine) * 1_000_003 + np.maximum(other, mine)).astype(np.uint64)))
        part = (key % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        return block, copies, values, bounds, first, count, name_of, rep, which, unit[order], key[order], edge

    def units_of_blocks(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block, copies, values, bounds, first, count, name_of, rep, which, unit, key, edge = chosen(rows)
        if method.by_doc:
            owner = np.array([LAST if i is None else i for i in block.ids], np.int64)[np.searchsorted(bounds, first, "right") - 1]
            weight = np.full(len(rep), LAST, np.int64)
            np.minimum.at(weight, which, owner)
        else:
            weight = np.bincount(which, minlength=len(rep)).astype(np.int64) * copies
        out = []
        for p in np.flatnonzero(np.diff(edge)).tolist():
            u = unit[edge[p] : edge[p + 1]]
            size = count[rep[u]] + method.window - 1
            payload = values[spans(first[rep[u]], size)]
            out.append(_row(UNIT, rows[0]["block"], p, None, pack(key[edge[p] : edge[p + 1]], name_of[rep[u]], size.astype(np.int32), weight[u], payload)))
        return _table(out)

    def answered(table: pa.Table) -> pa.Table:
        rows = [unpack(b, np.uint64, np.uint64, np.int32, np.int64, method.value) for b in table.column("blob").to_pylist()]
        key, name_of, size, weight, payload = (np.concatenate(x) for x in zip(*rows, strict=True))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        distinct, rep, which = np.unique(mixed(name_of ^ mixed(key)), return_index=True, return_inverse=True)
        if method.by_doc:
            total = np.full(len(distinct), LAST, np.int64)
            np.minimum.at(total, which, weight)
        else:
            total = np.bincount(which, weight, len(distinct)).astype(np.int64)
        windows = size[rep] - method.window + 1
        where = np.cumsum(windows) - windows
        _, group, members = np.unique(key[rep], return_inverse=True, return_counts=True)
        given = np.where(members[group] == 1, method.alone(total), -1)
        answer = np.repeat(given, windows).astype(method.answer)
        order = np.flatnonzero(given < 0)
        order = order[np.argsort(group[order], kind="stable")]  # all units of a key, then the next key
        heads = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else order
        ends, grown, i = np.append(heads[1:], len(order)), np.cumsum(size[rep][order]), 0
        while i < len(heads):
            base = grown[heads[i] - 1] if heads[i] else 0
            j = max(i + 1, int(np.searchsorted(grown[ends - 1], base + method.shard, "right")))
            mine = order[heads[i] : ends[j - 1]]
            # a unit under several keys of a dealt anchor stands in the shard once, or it would match itself
            _, one, back = np.unique(name_of[rep[mine]], return_index=True, return_inverse=True)
            once, n = mine[one], windows[mine]
            r = rep[once]
            found = method.index(payload[spans(begin[r], size[r])], size[r], total[once])
            answer[spans(where[mine], n)] = found[spans((np.cumsum(windows[once]) - windows[once])[back], n)]
            i = j
        edges = np.cumsum([0, *[len(r[0]) for r in rows]])
        blocks, part = table.column("block").to_pylist(), table.column("part").to_pylist()
        out = []
        for b, p, lo, hi in zip(blocks, part, edges[:-1], edges[1:], strict=True):
            u = which[lo:hi]
            out.append(_row(MARK, b, p, None, pack(answer[spans(where[u], windows[u])])))
        return _table(out)

    def finished(known: pa.Table, marks: pa.Table) -> pa.Table:
        block, copies, _, _, first, count, _, rep, which, unit, _, edge = chosen(known.to_pylist())
        n = count[rep]
        at = np.cumsum(n) - n
        best = np.full(int(n.sum()), LAST if method.by_doc else 0, method.answer)
        got = dict(zip(marks.column("part").to_pylist(), marks.column("blob").to_pylist(), strict=True))
        for p in np.flatnonzero(np.diff(edge)).tolist():
            if p not in got:
                raise ValueError("a block came back without the answers to some of its units")
            u = unit[edge[p] : edge[p + 1]]
            (np.minimum if method.by_doc else np.maximum).at(best, spans(at[u], n[u]), unpack(got[p], method.answer)[0])
        return pa.concat_tables([finish(block, first, count, best[spans(at[which], count)])] * copies)

    # texts and counts are shuffled by block once: both stages of the blocks read the same exchange
    told = docs.mapInArrow(anchors_of_blocks, ROWS).groupBy("part").applyInArrow(counted, ROWS)
    blocks = docs.mapInArrow(texts_of_blocks, ROWS).unionByName(told).groupBy("block")
    marks = blocks.applyInArrow(units_of_blocks, ROWS).groupBy("part").applyInArrow(answered, ROWS)
    return blocks.cogroup(marks.groupBy("block")).applyInArrow(finished, schema)


def _content(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of symbols, as differences of one sum over all symbols times powers of an odd number."""
    factor = 0x5851F42D4C957F2D
    powers = np.full(len(values) + 1, factor, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + _U(0x632BE59BD9B4E019)) * powers[:-1], out=sums[1:])
    back = np.full(len(values) + 1, pow(factor, -1, 2**64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((sums[first + length] - sums[first]) * back[first] ^ mixed(length.astype(np.uint64)))
