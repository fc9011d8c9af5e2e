"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling.

A word's inputs are its own log odds (word input) and the highest log odds among its runs of 3, 4 and 5 bytes (character
inputs), from tables of fixed size that are counted on labelled documents. The network reads windows of 32 words, each
8 words over the one before, through to the end of every text; the score of a document comes from its highest window,
brought to a probability on the labelled documents. All of it is trained here, in numpy, on at most `SAMPLE` documents
of either kind that are not held out and have no more than `LONGEST` characters; scores cover all documents.

Held out: crc32(doc_id as text) mod 4 is 2 (a null doc_id is not). Labels, lang, source and doc_id are inputs of no
score. A null or empty text gets the score of a window without words. Repeated rows score alike. Without labels of
both kinds every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_ready
from .recurrent import Network
from .textarrays import mixed, part_hashes, slices, texts, words

QUERY = "op6_toxicity"
SQL = None
SAMPLE, LONGEST = 2_000, 100_000
WINDOW, STRIDE = 32, 24
SLOTS = 1 << 18
RUNS = (3, 4, 5)
THRESHOLD = 0.3
#: Bytes cut from either end of a word.
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def read_words(data: np.ndarray, offsets: np.ndarray):
    """(small letters, starts, ends of the distinct words, place of each word among them, words per document)."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, n = words(data, offsets)
    if len(starts):
        for _ in range(8):
            ends = ends - ((ends - starts > 1) & _MARK[data[ends - 1]])
            starts = starts + ((ends - starts > 1) & _MARK[data[starts]])
    hashes = part_hashes(data, starts, ends)
    known, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return data, starts[first], ends[first], known, place, n


def run_slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each byte of <word> and each length of run, its slot or -1; and where the words begin."""
    length = ends - starts + 2
    first = np.cumsum(length) - length
    room = np.zeros(int(length.sum()) + max(RUNS), np.uint64)
    inner = np.ones(int(length.sum()), bool)
    inner[first], inner[first + length - 1] = False, False
    at = np.arange(int((length - 2).sum())) - np.repeat(np.cumsum(length - 2) - (length - 2), length - 2) + np.repeat(starts, length - 2)
    room[: len(inner)][inner] = data[at].astype(np.uint64) + np.uint64(3)
    room[first], room[first + length - 1] = 1, 2
    left = np.repeat(first + length, length) - np.arange(len(inner))
    out = []
    for n in RUNS:
        h = np.zeros(len(inner), np.uint64)
        for k in range(n):
            h = (h << np.uint64(9)) ^ room[k : k + len(inner)]
        slot = (mixed(h + np.uint64(n * 0x9E3779B9)) % np.uint64(SLOTS)).astype(np.int64)
        out.append(np.where(left >= n, slot, -1))
    return out, first


@dataclass
class Model:
    word_table: np.ndarray
    run_tables: list[np.ndarray]
    network: Network
    slope: float
    shift: float

    def inputs(self, data, starts, ends, known) -> np.ndarray:
        """Inputs of the distinct words."""
        if len(known) == 0:
            return np.zeros((0, 1 + len(RUNS)), np.float32)
        out = [self.word_table[(known % np.uint64(SLOTS)).astype(np.int64)]]
        slots, first = run_slots(data, starts, ends)
        for table, slot in zip(self.run_tables, slots, strict=True):
            out.append(np.maximum.reduceat(np.where(slot >= 0, table[slot], np.float32(-4)), first))
        return np.clip(np.stack(out, axis=1), -4, 4).astype(np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        data, starts, ends, known, place, n = read_words(data, offsets)
        x = np.concatenate([self.inputs(data, starts, ends, known), np.zeros((1, 1 + len(RUNS)), np.float32)])
        ready = self.network.projected(x)
        doc, at = windows(n)
        best = np.full(len(n), -np.inf)
        full = n[doc] >= WINDOW
        for part, masked in ((np.flatnonzero(full), False), (np.flatnonzero(~full), True)):
            for i in range(0, len(part), 4096):
                rows = part[i : i + 4096]
                places, mask = gathered(place, n, doc[rows], at[rows], len(known))
                np.maximum.at(best, doc[rows], self.network.logits(ready, places, mask if masked else None))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and first word of each window; the last window of a long text ends with it, an empty text has one."""
    count = np.where(n <= WINDOW, 1, 1 + -(-(n - WINDOW) // STRIDE)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))


def gathered(place, n, doc, at, empty: int):
    """Places of the words of windows, and the mask of the places that have a word."""
    inside = at[:, None] + np.arange(WINDOW)
    mask = inside < n[doc][:, None]
    before = (np.cumsum(n) - n)[doc][:, None]
    return np.where(mask, np.append(place, empty)[np.where(mask, before + inside, len(place))], empty), mask.astype(np.float32)


def train(column, toxic: np.ndarray, top: int = 3, other: int = 3) -> Model | None:
    """Tables, network and scale from texts and their labels (0 or 1)."""
    if len(set(toxic.tolist())) < 2:
        return None
    data, starts, ends, known, place, n = read_words(*texts(column))
    kind = toxic[np.repeat(np.arange(len(n)), n)]
    pairs = np.unique(np.repeat(np.arange(len(n)), n) * (len(known) + 1) + place)
    of_word, of_doc = pairs % (len(known) + 1), pairs // (len(known) + 1)
    ratio = toxic.sum() / (1 - toxic).sum()
    count = [np.bincount(of_word[toxic[of_doc] == k], minlength=len(known)) for k in (0, 1)]

    def odds(slot, counts, prior):
        c = [np.bincount(slot, v, SLOTS) for v in counts]
        return np.log((c[1] + prior) / (c[0] * ratio + prior)).astype(np.float32)

    word_table = odds((known % np.uint64(SLOTS)).astype(np.int64), count, 5.0)
    slots, first = run_slots(data, starts, ends)
    owner = np.repeat(np.arange(len(known)), np.diff(np.append(first, len(slots[0]))))
    run_tables = [odds(s[s >= 0], [c[owner[s >= 0]] for c in count], 10.0) for s in slots]
    model = Model(word_table, run_tables, Network(1 + len(RUNS)), 1.0, 0.0)
    x = np.concatenate([model.inputs(data, starts, ends, known), np.zeros((1, 1 + len(RUNS)), np.float32)])
    doc, at = windows(n)
    # windows to learn from: of each document those with the highest inputs, and as many others of clean documents
    places, mask = gathered(place, n, doc, at, len(known))
    strength = (x[places].max(2) * mask).max(1)
    order = np.lexsort((-strength, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    spread = np.random.default_rng(5).random(len(doc)) < other / np.maximum(np.bincount(doc)[doc], 1)
    rows = np.flatnonzero(np.where(toxic[doc] == 1, rank < 1, (rank < top) | spread))
    y = toxic[doc[rows]].astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    model.network.fit(x[places[rows]], y, weight, mask[rows])
    best = np.full(len(n), -np.inf)
    ready = model.network.projected(x)
    for i in range(0, len(doc), 4096):
        part = slice(i, i + 4096)
        np.maximum.at(best, doc[part], model.network.logits(ready, places[part], mask[part]))
    model.slope, model.shift = _scale(best, toxic)
    return model


def _scale(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic curve over the highest logits, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w, d = p * (1 - p) + 1e-6, p - y
        h = np.array([[(w * logit * logit).sum() + 1.0, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1.0]])
        g = np.array([(d * logit).sum() + (a - 1.0), d.sum() + b])
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return float(max(a, 0.05)), float(b)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most `sample` toxic and `sample` clean documents, those with the smallest hash of doc_id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one, two = (known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1))
    chosen = docs.select("doc_id", "text").filter(F.length("text") <= LONGEST).join(F.broadcast(one.union(two)), "doc_id")
    got = chosen.select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(got.column("text"), got.column("toxic").to_numpy().astype(np.int64)) if got.num_rows else None


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text", 1_000_000):
            s = np.zeros(rows.num_rows) if spread.value is None else spread.value.score(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
