"""Token counts with overlap resynchronisation for huge documents.

A document of up to `CHUNK` characters is encoded at once. A longer one is encoded in overlapping chunks with offsets,
and the chunks are spliced where that is proven to change nothing. The splitting pattern looks at most one character
ahead and never back, and merges stay inside its words; so from a place at which a word truly starts, the rest of a
chunk is split as the whole text would be. A word start is taken from the left chunk, which is known to be right up to
it, where it lies before the left chunk's last `MARGIN` characters and the right chunk has a word start at it too. If
the overlap holds no such place (one word may be longer than it), it is widened twofold, at last to all of the text.
Memory holds the encoding of a chunk, not of a document.

A null text is empty and has no tokens. Repeated rows are counted each. An empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, python_ready
from .encoding import VOCABULARY, tokenizer, vocabulary_path

QUERY = "op10_token_counts"
SQL = None
CHUNK, OVERLAP = 32_768, 512
MARGIN = 32  # more than the special string and one character ahead
LIMIT = 1024
TOGETHER = 200_000  # characters that are encoded in one call


class Counter:
    def __init__(self, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN):
        self.token, self.chunk, self.overlap, self.margin = tokenizer(vocabulary_path(vocabulary)), chunk, overlap, margin
        self.widened = 0

    def _words(self, text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places in the text at which words start, the tokens before each, and all tokens of text[start:stop]."""
        found = self.token.encode(text[start:stop], add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        at = np.array([a for a, _ in found.offsets], np.int64)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        return at[first] + start, first, len(word)

    def long(self, text: str) -> int:
        """Tokens of a text of more than a chunk."""
        start, done, overlap = 0, 0, self.overlap
        stop = self.chunk
        left = self._words(text, start, stop)
        base = 0  # tokens of the left chunk before the place that it is right from
        while stop < len(text):
            fresh = max(start, stop - overlap)
            end = min(len(text), fresh + max(self.chunk, 2 * overlap))
            right = self._words(text, fresh, end)
            both = np.intersect1d(left[0], right[0])
            both = both[(both < stop - self.margin) & (both > fresh)]
            both = both[both >= self._from] if start else both
            if len(both) == 0:
                self.widened += 1
                if fresh > start:
                    overlap *= 2
                    continue
                # the overlap is the whole left chunk: encode it again with as much text again behind
                stop = min(len(text), start + 2 * (stop - start))
                left = self._words(text, start, stop)
                base = int(left[1][np.searchsorted(left[0], self._from)]) if start else 0
                continue
            cut = int(both[-1])
            done += int(left[1][np.searchsorted(left[0], cut)]) - base
            base = int(right[1][np.searchsorted(right[0], cut)])
            start, stop, left, overlap = fresh, end, right, self.overlap
            self._from = cut
        return done + left[2] - base

    _from = 0

    def all(self, texts: list[str]) -> np.ndarray:
        out, group, size = np.zeros(len(texts), np.int64), [], 0

        def flush():
            for i, e in zip(group, self.token.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
                out[i] = len(e)
            group.clear()

        for i, text in enumerate(texts):
            if len(text) > self.chunk:
                self._from = 0
                out[i] = self.long(text)
                continue
            if size + len(text) > TOGETHER:
                flush()
                size = 0
            group.append(i)
            size += len(text)
        flush()
        return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    python_ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = counter.all(texts)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir, "doc_id", "text"))
