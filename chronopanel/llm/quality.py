"""Quality rules: fixed counts of every text, then boosted trees over document statistics.

The trees learn `labels.quality` from the statistics of at most `SAMPLE` labelled documents (those with the smallest
hash of doc_id), and their score must not rise with the shares of symbols, repeated lines, repeated words and
exclamation marks. All statistics are computed over whole texts of all documents.

A null text has no words and fails the fixed rules. Repeated rows are judged alike. Without labels of both kinds only
the fixed rules decide. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import documents, python_ready
from .textarrays import chained, mixed, part_hashes, slices, words

QUERY = "op5_quality_rules"
SQL = None
SAMPLE = 20_000
LEAST_WORDS, MOST_REPEATED, KEEP_FROM = 50, 0.5, 0.5
SYMBOLS, CAPITAL, DIGIT, STOP = (np.zeros(256, bool) for _ in range(4))
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITAL[65:91] = True
DIGIT[48:58] = True
STOP[list(b".,;:")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics for the trees, with the sign of each (-1: the score must not rise with it).
FEATURES = {"log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "capitals": 0, "marks": -1, "bars": 0, "digits": 0, "stops": 0, "line_words": 0, "wide": 0, "bytes_of_word": 0}


def _equal_counts(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the number of entries of its owner with its hash, and whether it is the first of them."""
    key = mixed(hashes ^ mixed(owner.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    size = np.diff(np.r_[np.flatnonzero(new), len(key)])
    count, first = np.empty(len(key), np.int64), np.empty(len(key), bool)
    count[order], first[order] = np.repeat(size, size), new
    return count, first


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of BASE (integers) and the FEATURES of each document."""
    n_docs = len(offsets) - 1
    starts, ends, n = words(data, offsets)
    owner = np.repeat(np.arange(n_docs), n)
    per_doc = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offsets])
    in_word = np.zeros(len(data) + 1, np.int32)
    in_word[starts] += 1
    np.subtract.at(in_word, ends, 1)
    letters = np.cumsum(in_word[:-1]).astype(bool) & ((data & 0xC0) != 0x80)
    word_chars, symbols = per_doc(letters), per_doc(SYMBOLS[data])
    # lines: bounds at every \n and at the ends of documents
    breaks = np.flatnonzero(data == 10)
    begin, end = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    spoken = np.searchsorted(starts, end) > np.searchsorted(starts, begin)  # lines with a word
    begin, end = begin[spoken], end[spoken]
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    _, first = _equal_counts(line_doc, part_hashes(data, begin, end)) if len(begin) else (None, np.zeros(0, bool))
    lines, dup_lines = np.bincount(line_doc, minlength=n_docs), np.bincount(line_doc[~first], minlength=n_docs)
    # words of 3-word windows that are there twice or more
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        same = owner[2:] == owner[:-2]
        at = np.flatnonzero(same)
        count, _ = _equal_counts(owner[at], chained(part_hashes(data, starts, ends), 3)[at])
        again = at[count > 1]
        for k in range(3):
            covered[again + k] = True
    repeats = np.bincount(owner[covered], minlength=n_docs)
    base = np.stack([n, word_chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    x = np.stack([
        np.log1p(n), word_chars / some, symbols / some, dup_lines / np.maximum(lines, 1), repeats / some, per_doc(CAPITAL[data]) / size,
        per_doc(data == 33) / some, per_doc(data == 124) / some, per_doc(DIGIT[data]) / size, per_doc(STOP[data]) / some,
        some / np.maximum(lines, 1), per_doc(data >= 128) / size, size / some,
    ], axis=1)
    return base, x


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches, "text"):
        _, x = statistics(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column("quality").cast(pa.int32()), *[pa.array(c) for c in x.T]], ["quality", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Trees:
    """Fitted on at most `sample` labelled documents, whose statistics (13 numbers each) come to the driver."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = known.mapInArrow(_sampled, "quality int, " + ", ".join(f"{n} double" for n in FEATURES)).toArrow()
    x = np.stack([got.column(n).to_numpy() for n in FEATURES], axis=1)
    order = np.lexsort(x.T)  # the same trees whatever order the rows arrive in
    return boosting.fit(x[order], got.column("quality").to_numpy()[order].astype(float), np.array(list(FEATURES.values())))


def judged(docs: DataFrame, trees: boosting.Trees, carry: list[str] | None = None) -> DataFrame:
    """`row` (all columns of the documents, or those to carry) and `verdict` (the counts, the score, both decisions)."""
    kinds = "struct<" + ", ".join(f"{n}:bigint" for n in BASE) + ", score:double, base_failed:boolean, kept:boolean>"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "__text"):
            base, x = statistics(data, offsets)
            failed = (base[:, 0] < LEAST_WORDS) | (base[:, 4] > MOST_REPEATED * base[:, 0])
            score = trees.score(x)
            fields = [*[pa.array(c) for c in base.T], pa.array(score), pa.array(failed), pa.array(~failed & (score >= KEEP_FROM))]
            verdict = pa.StructArray.from_arrays(fields, [*BASE, "score", "base_failed", "kept"])
            yield pa.RecordBatch.from_arrays([rows.column("row"), verdict], ["row", "verdict"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col("text").alias("__text"))
    return packed.mapInArrow(judge, f"row {packed.schema['row'].dataType.simpleString()}, verdict {kinds}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_ready(spark)
    docs = documents(spark, sf_dir, "doc_id", "text")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, trees, ["doc_id"]).select("row.doc_id", *[f"verdict.{n}" for n in BASE], "verdict.base_failed", "verdict.kept", "verdict.score")
