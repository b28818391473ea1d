"""Documents as numbers into the word table of their block.

A block is a run of documents of one task, about BLOCK_CHARS of text (or as many as the caller says).  Each of
its distinct words is written once; a document is the sequence of its words'
numbers in the block, most frequent first, so that numbers are short.  What has
to be known about a word is joined to (block, bucket) rows, each the block's
words of one hash bucket, far fewer bytes than the words of all documents; the
answer comes back in the order of those words and goes to the positions by number.
Nothing is kept for longer than a block, so memory is bounded by its size.

Rows of a block, by ``kind``: DOCUMENTS (up to PART_DOCS of them), WORDS (one
row a bucket, ``at``, words sorted), ORDER (the place of each number among the
words of all buckets) and EXTRA, what the caller adds.

Defined cases: null text is empty and has no words.  Repeated rows and rows of
null doc_id are kept each for itself.  No rows: no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store_by
from .tokens import ragged

BLOCK_CHARS = 16_000_000
PART_DOCS = 2000
BUCKET_BYTES = 64_000_000
DOCUMENTS, WORDS, ORDER, EXTRA = range(4)
SCHEMA = "block long, kind int, at int, doc_id array<long>, flag array<boolean>, n array<long>, data binary"
_FIELDS = [
    ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int32()), ("doc_id", pa.list_(pa.int64())),
    ("flag", pa.list_(pa.bool_())), ("n", pa.list_(pa.int64())), ("data", pa.binary()),
]
_PREFIX = 16


def _press(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(data)


def _unpress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers (not negative, or floats bit by bit) as compressed byte planes."""
    raw = np.ascontiguousarray(numbers).astype("<f8" if numbers.dtype.kind == "f" else "<u8").view(np.uint8).reshape(-1, 8)
    planes = 8 if numbers.dtype.kind == "f" else max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + _press(np.ascontiguousarray(raw[:, :planes].T).tobytes())


def unsqueeze(data: bytes, dtype: str = "<u8") -> np.ndarray:
    planes = data[0]
    flat = np.frombuffer(_unpress(data[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((flat.shape[1], 8), np.uint8)
    out[:, :planes] = flat.T
    return out.view(dtype)[:, 0]


def join(*parts: bytes) -> bytes:
    return b"".join([len(p).to_bytes(4, "little") + p for p in parts])


def split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_words(words: list[bytes]) -> bytes:
    """Sorted words, each without what its first bytes share with the word before."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
    head = np.zeros((len(words), _PREFIX), np.uint8)
    k = np.minimum(n, _PREFIX)
    head[np.repeat(np.arange(len(words)), k), ragged(np.zeros(len(words), np.int64), k)] = flat[ragged(start, k)]
    shared = np.zeros(len(words), np.int64)
    shared[1:] = np.minimum(np.cumprod(head[1:] == head[:-1], axis=1).sum(axis=1), np.minimum(n[1:], n[:-1]))
    return join(squeeze(shared), squeeze(n - shared), _press(flat[ragged(start + shared, n - shared)].tobytes()))


def unpack_words(data: bytes) -> list[bytes]:
    shared, n, rest = split(data)
    rest, out, before, at = _unpress(rest), [], b"", 0
    for k, size in zip(unsqueeze(shared).tolist(), unsqueeze(n).tolist(), strict=True):
        before = before[:k] + rest[at : at + size]
        at += size
        out.append(before)
    return out


#: What a caller adds to a block: from each document's numbers and flag and the words by number to the bytes of one EXTRA row.
Extra = Callable[[list[np.ndarray], list[bool], list[bytes]], bytes]


def coded(docs: DataFrame, cut: Callable[[], Callable[[str], list]], flag: Column, name: str, buckets: int, key: str = "doc_id", text: str = "text", extra: Extra | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The stored rows of SCHEMA for all documents, in files by hash of block: they are grouped by block without a shuffle.

    ``cut()`` gives a worker its function from a text to its words (str or
    bytes).  ``flag`` marks documents whose words count: a WORDS row holds the
    words of its bucket and the occurrences of each in those documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = cut()
        block = TaskContext.get().partitionId() << 24
        book: dict = {}
        kept: list[tuple] = []
        chars = 0

        def batch(kind: int, at: int, data: bytes, part: list[tuple] | None = None) -> pa.RecordBatch:
            lists = [[[k[0] for k in part]], [[k[1] for k in part]], [[len(k[2]) for k in part]]] if part is not None else [[None]] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip([[block], [kind], [at], *lists, [data]], _FIELDS, strict=True)], [c for c, _ in _FIELDS])

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal book, kept, chars, block
            size = len(book)
            tally = lambda those: np.bincount(np.concatenate([np.empty(0, np.uint32), *those]), minlength=size)
            by_rank = np.argsort(-tally([k[2] for k in kept]), kind="stable")
            counts = tally([k[2] for k in kept if k[1]])
            number = np.empty(size, np.uint32)
            number[by_rank] = np.arange(size, dtype=np.uint32)
            kept = [(doc, flagged, number[codes]) for doc, flagged, codes in kept]
            for at in range(0, len(kept), PART_DOCS):
                part = kept[at : at + PART_DOCS]
                yield batch(DOCUMENTS, at // PART_DOCS, squeeze(np.concatenate([k[2] for k in part])), part)
            words = [w if isinstance(w, bytes) else w.encode() for w in book]
            if extra:
                yield batch(EXTRA, 0, extra([k[2] for k in kept], [k[1] for k in kept], [words[i] for i in by_rank.tolist()]))
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, size)
            in_order = np.array(sorted(range(size), key=words.__getitem__), np.int64)
            in_order = in_order[np.argsort(of[in_order], kind="stable")]  # by bucket, then by word
            place = np.empty(size, np.int64)
            place[in_order] = np.arange(size)
            yield batch(ORDER, 0, squeeze(place[by_rank]))
            edges = np.searchsorted(of[in_order], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                mine = in_order[edges[bucket] : edges[bucket + 1]]
                yield batch(WORDS, bucket, join(pack_words([words[i] for i in mine.tolist()]), squeeze(counts[mine])))
            book, kept, chars, block = {}, [], 0, block + 1

        for b in batches:
            for doc, flagged, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                value = value.as_py() or ""
                found = words_of(value)
                for w in set(found).difference(book):
                    book[w] = len(book)
                kept.append((doc, flagged, np.fromiter(map(book.__getitem__, found), np.uint32, len(found))))
                chars += len(value)
                if chars >= block_chars:
                    yield from rows()
        if kept:
            yield from rows()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), flag.alias("flag"), F.col(text).alias("text"))
    return store_by(rows.mapInArrow(run, SCHEMA), name, "block", buckets)


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets of words: one a shuffle partition, and more where a bucket's words would come from over BUCKET_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def words_of(table: DataFrame) -> DataFrame:
    """(block, bucket, data): a row for each block and bucket of words; `read_words` reads data."""
    return table.filter(F.col("kind") == WORDS).select("block", F.col("at").alias("bucket"), "data")


def read_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words and their counts."""
    words, counts = split(data)
    return unpack_words(words), unsqueeze(counts)


def by_number(rows: pd.DataFrame, answers: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """For one block: the place of each number among the answers, and the answers' data by bucket."""
    order = rows[rows["kind"] == ORDER]["data"]
    return unsqueeze(order.iloc[0]).astype(np.int64) if len(order) else np.empty(0, np.int64), answers.sort_values("bucket")["data"].tolist()


def documents_of(rows: pd.DataFrame) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """For one block: doc_ids, flags, word counts and the numbers of all words of each part of its documents."""
    for r in rows[rows["kind"] == DOCUMENTS].sort_values("at").itertuples():
        yield list(r.doc_id), list(r.flag), np.asarray(r.n, np.int64), unsqueeze(r.data).astype(np.int64)
