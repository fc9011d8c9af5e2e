"""BPE encoding and decoding through a table of distinct words.

Spark splits every text into the words of the tokenizer's pattern. A block is some megabytes of one partition's words:
its distinct words, and for each document the places of its words among them. The distinct words of all blocks are
dealt by hash, so that equal words of all blocks meet in one part of the table, where each is encoded once; the ids go
back to the blocks and are joined to the documents by position. Decoding joins the ids to the pieces of the vocabulary,
whose size is fixed. Words and ids travel packed (one row for a block and a part of the table), which keeps the shuffle
below the size of the texts.

A null text is empty: no ids, and the empty text decoded. Repeated rows are encoded each. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, python_ready, text_or_empty

QUERY = "op8_bpe_encoding"
SQL = None
SPECIAL = "<|endoftext|>"
VOCABULARY = "byte_bpe_50k.json"
BLOCK = 8_000_000  # bytes of words in a block
ROWS_OF_BLOCK = 20_000
_SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The published splitting pattern of the vocabulary, with its classes spelt out for this engine.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
ROWS = "kind int, block long, part int, docs array<long>, sizes array<int>, blob binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokenizer(path: str):
    """The library's tokenizer, alone in its thread, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_words(text):
    """Words of the pattern; the special string is a word of its own and splits the text around it first."""
    find = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    parts = F.split(text, r"<\|endoftext\|>", -1)
    apart = F.flatten(F.transform(parts, lambda p: F.concat(F.array(F.lit(SPECIAL)), find(p))))
    return F.when(text.contains(SPECIAL), F.slice(apart, F.lit(2), F.greatest(F.size(apart) - 1, F.lit(0)))).otherwise(find(text))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_words(words: pa.Array) -> bytes:
    offsets, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
    text = b"" if data is None else bytes(memoryview(data)[offsets[0] : offsets[-1]])
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(words)).tobytes() + np.diff(offsets).astype(np.int32).tobytes() + text)


def _unpack_words(blob: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 8))]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[8 + 4 * n :]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(doc_ids with a validity mask, list of words) of some megabytes each, at least one document."""
    held, size, rows = [], 0, 0
    for batch in batches:
        lists = batch.column("words")
        if isinstance(lists, pa.ListArray) and len(lists):
            offsets = np.frombuffer(lists.values.slice(0).buffers()[1], np.int32)
            ends = offsets[np.asarray(lists.offsets) + lists.values.offset]
            i = 0
            while i < len(lists):
                fits = int(np.searchsorted(ends, ends[i] + BLOCK - size, "right")) - 1
                j = max(i + 1, min(len(lists), fits, i + ROWS_OF_BLOCK - rows))
                held.append((batch.column("doc_id").slice(i, j - i), lists.slice(i, j - i)))
                size, rows = size + int(ends[j] - ends[i]), rows + j - i
                i = j
                if size >= BLOCK or rows >= ROWS_OF_BLOCK or i < len(lists):
                    yield pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
                    held, size, rows = [], 0, 0
    if held:
        yield pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])


def _parts_of(words: pa.Array, parts: int) -> np.ndarray:
    """The part of the table of each word, by its bytes."""
    from .textarrays import part_hashes

    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (part_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int64)


def _distinct(lists: pa.Array, parts: int):
    """Distinct words of a block in the order (part, first place), the bounds of the parts, and each word's place.

    The name of the block is a hash of the words and their order, so a repeated scan gives the same names."""
    coded = lists.flatten().dictionary_encode()
    words, places = coded.dictionary, np.asarray(coded.indices)
    part = _parts_of(words, parts)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    words = words.take(pa.array(order))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    name = int.from_bytes(hashlib.blake2b(_pack_words(words), digest_size=8).digest(), "little", signed=True)
    return name, words, bounds, place[places]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return _joined(docs, vocabulary, parts, digests=True)


def encode_ids(docs: DataFrame, vocabulary: str = VOCABULARY, parts: int | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of each row."""
    return _joined(docs, vocabulary, parts, digests=False)


def _joined(docs: DataFrame, vocabulary: str, parts: int | None, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    python_ready(spark)
    parts = parts or 2 * partitions(spark)
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(text_or_empty()).alias("words"))

    def row(kind, block, part, ids, sizes, blob):
        fields = [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([blob], pa.binary())]
        return pa.RecordBatch.from_arrays(fields, ["kind", "block", "part", "docs", "sizes", "blob"])

    def words_of_blocks(batches):
        for _, lists in _blocks(batches):
            name, words, bounds, _ = _distinct(lists, parts)
            for p in range(parts):
                if bounds[p] < bounds[p + 1]:
                    yield row(1, name, p, None, None, _pack_words(words.slice(bounds[p], bounds[p + 1] - bounds[p])))

    def places_of_blocks(batches):
        for ids, lists in _blocks(batches):
            name, _, _, places = _distinct(lists, parts)
            yield row(0, name, -1, ids.to_pylist(), np.diff(np.asarray(lists.offsets)).tolist(), _pack(places.astype(np.int32)))

    def encoded_once(table: pa.Table) -> pa.Table:
        """All blocks' words of one part of the table: distinct words, ids of each, answers in the blocks' order."""
        token = tokenizer(vocabulary_path(vocabulary))
        lists = [_unpack_words(b) for b in table.column("blob").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        words, flat, sizes = coded.dictionary, [], np.zeros(len(coded.dictionary), np.int64)
        for i in range(0, len(words), 2000):
            found = [e.ids for e in token.encode_batch_fast(words.slice(i, 2000).to_pylist(), add_special_tokens=False)]
            sizes[i : i + len(found)] = [len(x) for x in found]
            flat.append(np.fromiter((k for x in found for k in x), np.uint32))
        flat, first = np.concatenate(flat), np.cumsum(sizes) - sizes
        at, blobs, places = 0, [], np.asarray(coded.indices)
        for one in lists:
            mine = places[at : at + len(one)]
            at += len(one)
            n = sizes[mine]
            gather = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            blobs.append(_pack(np.concatenate([[len(one)], n, flat[gather]]).astype(np.uint32)))
        return pa.table({"kind": pa.array([2] * len(blobs), pa.int32()), "block": table.column("block"), "part": table.column("part"), "docs": pa.nulls(len(blobs), pa.list_(pa.int64())), "sizes": pa.nulls(len(blobs), pa.list_(pa.int32())), "blob": pa.array(blobs, pa.binary())})

    def by_position(table: pa.Table) -> pa.Table:
        """The ids of one block's words, put where its documents have them."""
        rows = table.to_pylist()
        answers = {r["part"]: r["blob"] for r in rows if r["kind"] == 2}
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for p in sorted(answers):
            a = _unpack(answers[p], np.uint32)
            sizes.append(a[1 : 1 + int(a[0])].astype(np.int64)), flat.append(a[1 + int(a[0]) :])
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        first, pieces, out = np.cumsum(sizes) - sizes, _pieces(vocabulary), []
        for r in rows:
            if r["kind"] == 0:
                places, at = _unpack(r["blob"], np.int32), 0
                if len(places) and int(places.max()) >= len(sizes):
                    raise ValueError("a block came back without some of its words")
                for doc, n in zip(r["docs"], r["sizes"], strict=True):
                    mine = places[at : at + n]
                    at += n
                    k = sizes[mine]
                    ids = flat[np.repeat(first[mine] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))]
                    out.append((doc, ids, _decoded(ids, *pieces)))
        if digests:
            columns = [[doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()] for doc, ids, text in out]
            names, kinds = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.int64(), pa.string(), pa.string())
        else:
            columns = [[doc, ids.tolist(), text.decode()] for doc, ids, text in out]
            names, kinds = ("doc_id", "ids", "decoded"), (pa.int64(), pa.list_(pa.int64()), pa.string())
        return pa.table({n: pa.array([c[k] for c in columns], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    table = split.select("words", "doc_id").mapInArrow(words_of_blocks, ROWS).groupBy("part").applyInArrow(encoded_once, ROWS)
    blocks = split.select("words", "doc_id").mapInArrow(places_of_blocks, ROWS)
    return blocks.unionByName(table).groupBy("block").applyInArrow(by_position, DIGESTS if digests else "doc_id long, ids array<long>, decoded string")


_PIECES: dict = {}


def _pieces(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces, bounds by id); the letters that stand for bytes in a byte-level vocabulary are undone."""
    if vocabulary not in _PIECES:
        token = tokenizer(vocabulary_path(vocabulary))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {i: t.content for i, t in token.get_added_tokens_decoder().items()}
        names = {i: w for w, i in token.get_vocab(True).items()}
        raw = [b"" if i not in names else special[i].encode() if i in special else bytes(byte_of[c] for c in names[i]) for i in range(max(names) + 1)]
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
        _PIECES[vocabulary] = (np.frombuffer(b"".join(raw), np.uint8), bounds)
    return _PIECES[vocabulary]


def _decoded(ids: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> bytes:
    """The bytes of the ids' pieces; what is no UTF-8 becomes U+FFFD."""
    if len(ids) == 0:
        return b""
    n = np.diff(bounds)[ids]
    raw = data[np.repeat(bounds[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()
    return raw.decode("utf-8", errors="replace").encode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir, "doc_id", "text"))
