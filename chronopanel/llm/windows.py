"""Substring dedup by words with an FM-index for each shard.

Words of a text are symbols; a window is 13 of them. The exchange of `anchors` brings together all texts around
windows that share an anchor. A part of the corpus becomes a shard: its texts are concatenated, the Burrows-Wheeler
transform goes into a wavelet tree, and every window of the streamed texts is searched backwards, all in lockstep; a
search ends when only its own text is left. A window that comes through has matching statistics of 13 or more, and the
smallest doc_id of the texts in its interval is the answer. Documents drop the words of windows whose answer is smaller
than their own doc_id.

A null text has no words. A null doc_id stands after all others. Repeated rows have one doc_id and so keep their words.
An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import LAST, Block, Method, meet, spans
from .common import documents
from .fmindex import FmIndex
from .textarrays import part_hashes, words

QUERY = "op7_substring_words"
WINDOW, RUN, SHARD = 13, 5, 400_000


def _symbols(data: np.ndarray, offsets: np.ndarray):
    starts, ends, n = words(data, offsets)
    hashes = part_hashes(data, starts, ends)
    return hashes, hashes, np.concatenate([[0], np.cumsum(n)])


def least_doc(values: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each window of each text of a shard, the smallest weight of the texts that hold it."""
    windows = length - WINDOW + 1
    owner = np.repeat(np.arange(len(length)), windows)
    out = weight[owner].copy()
    known, symbol = np.unique(values, return_inverse=True)
    place = np.arange(len(values)) + np.repeat(np.arange(len(length)), length)  # one end mark after each text
    text = np.zeros(len(values) + len(length), np.int64)
    text[place] = symbol + 1
    index = FmIndex(text, WINDOW)
    start = spans(np.cumsum(length + 1) - (length + 1), windows)
    live, low, high = np.arange(len(start)), np.zeros(len(start), np.int64), np.full(len(start), len(text))
    for k in range(WINDOW - 1, -1, -1):
        low, high = index.back(text[start[live] + k], low, high)
        more = high - low > 1
        live, low, high = live[more], low[more], high[more]
        if len(live) == 0:
            return out
    held = np.full(len(text), LAST, np.int64)
    held[place] = np.repeat(weight, length)
    held = np.append(held[index.order], LAST)
    interval, inverse = np.unique(low, return_inverse=True)
    end = np.empty(len(interval), np.int64)
    end[inverse] = high
    least = np.minimum.reduceat(held, np.stack([interval, end], axis=1).ravel())[::2]
    out[live] = least[inverse]
    return out


METHOD = Method(WINDOW, RUN, _symbols, np.uint64, np.int64, True, least_doc, lambda weight: weight, SHARD)


def _removed(block: Block, first: np.ndarray, count: np.ndarray, answers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words of the block lie in a window that starts in a document with a smaller doc_id."""
    owner = np.array([LAST if i is None else i for i in block.ids], np.int64)
    at = spans(first, count)
    gone = at[answers < owner[np.searchsorted(bounds, at, "right") - 1]]
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _digests(block: Block, first, count, answers) -> pa.Table:
    pieces, bounds = [], [np.zeros(1, np.int64)]
    for i, data, offsets in block.pieces():
        starts, ends, n = words(data, offsets)
        pieces.append((i, data, starts, ends, n))
        bounds.append(bounds[-1][-1] + np.cumsum(n))
    bounds = np.concatenate(bounds)
    gone = _removed(block, first, count, answers, bounds)
    n_words, n_removed, digest = [], [], []
    for i, data, starts, ends, n in pieces:
        away = gone[bounds[i] : bounds[i + len(n)]]
        keep = np.flatnonzero(~away)
        length = ends[keep] - starts[keep]
        begin = np.cumsum(length + 1) - (length + 1)
        text = np.full(int(length.sum()) + len(length), 32, np.uint8)
        text[spans(begin, length)] = data[spans(starts[keep], length)]
        kept = np.diff(np.concatenate([[0], np.cumsum(~away)])[np.concatenate([[0], np.cumsum(n)])])
        edge = np.append(begin, len(text))[np.concatenate([[0], np.cumsum(kept)])]
        n_words.extend(n.tolist()), n_removed.extend((n - kept).tolist())
        digest.extend(hashlib.sha256(text[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True))
    return pa.table({"doc_id": pa.array(block.ids.tolist(), pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def deduplicated(docs: DataFrame, method: Method = METHOD) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    return meet(docs, method, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir, "doc_id", "text"))


SQL = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT s, min(doc_id) AS least_id FROM win GROUP BY s),
gone AS (SELECT DISTINCT rid, i + k AS i FROM win JOIN firsts USING (s), (SELECT unnest(range(0, 13)) AS k) WHERE least_id < doc_id OR (doc_id IS NULL AND least_id IS NOT NULL)),
each AS (SELECT rid, i, ws[i] AS word FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
kept AS (SELECT e.rid, string_agg(word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON g.rid = e.rid AND g.i = e.i GROUP BY e.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)
"""
