"""Substring dedup by bytes with a run-length index for each shard.

Texts are bytes; a window is 200 of them. The exchange of `anchors` brings together all texts around windows that share
an anchor, equal texts once with their number. A shard's texts get a run-compressed Burrows-Wheeler transform; what the
first and the last place of each run share with their neighbours is sampled, and the matching statistics of all other
places follow from the sample before them. Places with statistics of 200 or more, and all windows of texts that are
there more than once, are removed from their documents.

A null text is empty. Matches never cross documents. Repeated rows match each other. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import Block, Method, meet, spans
from .common import documents
from .runindex import RunIndex
from .textarrays import mixed

QUERY = "op9_substring_bytes"
SQL = None
WINDOW, RUN, SHARD = 200, 32, 2_000_000
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _symbols(data: np.ndarray, offsets: np.ndarray):
    return _BYTE[data], data, offsets


def repeated(values: np.ndarray, length: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """1 for each window of each text of a shard that also starts elsewhere."""
    windows = length - WINDOW + 1
    out = np.repeat((weight > 1).astype(np.uint8), windows)
    long = RunIndex(values, length).statistics() >= WINDOW
    out |= long[spans(np.cumsum(length) - length, windows)].astype(np.uint8)
    return out


METHOD = Method(WINDOW, RUN, _symbols, np.uint8, np.uint8, False, repeated, lambda weight: np.where(weight > 1, 1, -1), SHARD)


def _digests(block: Block, first, count, answers) -> pa.Table:
    at = spans(first, count)[answers > 0]
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    rows = []
    for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        away = gone[a:b]
        runs = int(np.count_nonzero(away[1:] & ~away[:-1])) + int(len(away) > 0 and away[0])
        rows.append((b - a, int(away.sum()), runs, hashlib.sha256(block.data[a:b][~away].tobytes()).hexdigest()))
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    return pa.table({"doc_id": pa.array(block.ids.tolist(), pa.int64()), **{n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}})


def deduplicated(docs: DataFrame, method: Method = METHOD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    return meet(docs, method, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir, "doc_id", "text"))
