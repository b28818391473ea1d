"""Prediction by partial matching over bytes, trained and applied on a cluster.

A text is its words (A-Z in lower case), each followed by a space, and one end
symbol; the bytes of this are the symbols.  The context of a symbol is the ORDER
bytes before it, across words; before a text stand end symbols.  The trie of contexts holds, for each context
and next symbol, how often training text has it.  A symbol's probability starts
at the longest context: (2 c - 1) / (2 n) for a symbol counted c of n times
there; the share d / (2 n), d the number of distinct symbols, is the escape to
the context that is one byte shorter, where symbols already seen in the longer
one are excluded from n and d.  Below the empty context every byte not yet
excluded is equally likely.  The probabilities of all symbols sum to one.

Texts are held as word numbers by block (see `words`), from which their bytes are
made again batch by batch.  A block's distinct steps (context, symbol) are
counted once, dealt over tasks by the end of their context, and summed over
blocks there; the costs go back in the order in which the steps came.  Contexts
with a common end of two bytes meet in one task; ends that have more than a
task's share of the steps are dealt by their last three bytes, and the counts of
such ends (256 rows each, as many ends as tasks at most) go to every task, as do
orders one and zero: counts by (byte, byte), at most 65,536 rows.

The same blocks carry the base model's word counts: (c + 1) / (N + V + 1).

Defined cases: null text is empty: the end alone.  Without training documents
every symbol costs log10(256) and c, N and V are zero.  Repeated rows are
scored, and learnt from, each for itself.  Null doc_id is in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import store
from .tokens import ragged

ORDER = 5
TEXT_END = 0x0A
MASKS = [(1 << 8 * k) - 1 for k in range(ORDER + 1)]
#: Text of a block: its steps, in two tasks of an executor, are most of the memory.
BLOCK_CHARS = 8_000_000
#: Words of a batch of texts whose bytes are made at once.
BATCH_WORDS = 100_000
_MIX = 0x9E3779B97F4A7C15


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _splitter():
    return lambda text: text.encode().lower().split()


class Book:
    """Words by number as bytes, to write texts as symbols."""

    def __init__(self, word: list[bytes]):
        marked = [w + b" " for w in word] + [bytes([TEXT_END] * (ORDER + 1))]  # an end, and what stands before the next text
        self.end = len(word)
        self.n = np.fromiter(map(len, marked), np.int64, len(marked))
        self.first = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(marked), np.uint8)

    def symbols(self, codes: np.ndarray, before: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps (context << 8 | symbol) of the words ``codes`` after ``before`` (ORDER bytes), how many each word has, and the last ORDER bytes."""
        n = self.n[codes]
        flat = np.r_[np.frombuffer(before, np.uint8), self.flat[ragged(self.first[codes], n)]].astype(np.int64)
        key = flat[: len(flat) - ORDER].copy()
        for k in range(1, ORDER + 1):
            key = key << 8 | flat[k : len(flat) - ORDER + k]
        ends = np.flatnonzero(codes == self.end)
        counted = np.ones(len(key), bool)
        counted[ragged((np.cumsum(n) - n)[ends] + 1, np.full(len(ends), ORDER))] = False  # what stands before a text is given
        return key[counted], np.where(codes == self.end, 1, n), flat[-ORDER:].astype(np.uint8)


def batches(texts: list[np.ndarray], book: Book) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, steps, steps of each text) of runs of texts; a very long text comes in several."""
    start = bytes([TEXT_END] * ORDER)
    held: list[int] = []
    size = 0

    def of(some: list[int], codes: list[np.ndarray], before: bytes) -> tuple[tuple, bytes]:
        key, n, last = book.symbols(np.concatenate(codes), before)
        ends = np.cumsum([len(c) for c in codes])
        total = np.r_[0, np.cumsum(n)]
        return (np.array(some), key, total[ends] - total[np.r_[0, ends[:-1]]]), last.tobytes()

    for k, codes in enumerate(texts):
        if len(codes) > BATCH_WORDS:
            before = start
            whole = np.r_[codes, book.end]
            for at in range(0, len(whole), BATCH_WORDS):
                found, before = of([k], [whole[at : at + BATCH_WORDS]], before)
                yield found
            continue
        held.append(k)
        size += len(codes)
        if size >= BATCH_WORDS:
            yield of(held, [np.r_[texts[i], book.end] for i in held], start)[0]
            held, size = [], 0
    if held:
        yield of(held, [np.r_[texts[i], book.end] for i in held], start)[0]


def _sums(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(key, return_inverse=True)
    return unique, np.bincount(at, count, len(unique))


def _steps(texts: list[np.ndarray], flags: list[bool], word: list[bytes]) -> bytes:
    """The distinct steps of a block, ascending, and their counts in texts that are learnt from."""
    keys, counts = [np.empty(0, np.int64)], [np.empty(0)]
    book, learnt = Book(word), np.array(flags, bool)
    for some, key, n in batches(texts, book):
        train = np.repeat(learnt[some], n)
        k, c = np.unique(key[train], return_counts=True)
        keys += [k, np.unique(key[~train])]
        counts += [c.astype(np.float64), np.zeros(len(keys[-1]))]
        if len(keys) > 32:
            k, c = _sums(np.concatenate(keys), np.concatenate(counts))
            keys, counts = [k], [c]
    k, c = _sums(np.concatenate(keys), np.concatenate(counts))
    return words.join(words.squeeze(np.diff(k, prepend=0)), words.squeeze(c.astype(np.int64)))


def read_steps(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    key, count = words.split(data)
    return np.cumsum(words.unsqueeze(key).astype(np.int64)), words.unsqueeze(count).astype(np.int64)


class Finder:
    """Places of values in sorted distinct keys, mostly by one look into a hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, (4 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_MIX)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)].astype(np.int64)
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return at


class Level:
    """Counts of one order: for each context its n and d, and what the next longer contexts exclude."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        seen = counts > 0
        self.keys, self.counts = _sums(keys[seen], counts[seen])
        self.contexts, self.of = np.unique(self.keys >> 8, return_inverse=True)
        self.n = np.bincount(self.of, self.counts, len(self.contexts))
        self.d = np.bincount(self.of, minlength=len(self.contexts)).astype(np.float64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each context, and whether it is there."""
        if not len(self.contexts):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return at, self.contexts[at] == contexts


def step_costs(keys: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 probability of each step under the levels (order -> Level, all orders)."""
    out = np.zeros(len(keys))
    left = np.arange(len(keys))
    pad = lambda x: np.r_[x, 0.0]  # noqa: E731  so that an empty level can be indexed
    for order in range(ORDER, -1, -1):
        k = keys[left]
        context = (k >> 8) & MASKS[order]
        level = levels[order]
        at, hit = level.find(context)
        n, d = np.where(hit, pad(level.n)[at], 0.0), np.where(hit, pad(level.d)[at], 0.0)
        if order < ORDER:  # what the context one byte longer has seen is out
            longer = levels[order + 1]
            own = ((longer.keys >> 8 & MASKS[order]) << 8) | (longer.keys & 255)
            gone_n = np.bincount(longer.of, level.count(own), len(longer.contexts))
            at, hit = longer.find((k >> 8) & MASKS[order + 1])
            n, d = n - np.where(hit, pad(gone_n)[at], 0.0), d - np.where(hit, pad(longer.d)[at], 0.0)
        own = level.count((context << 8) | (k & 255))
        found = own > 0
        total = np.maximum(2 * n, 1.0)
        out[left[found]] += np.log10((2 * own[found] - 1) / total[found])
        escapes = ~found & (d > 0)
        out[left[escapes]] += np.log10(d[escapes] / total[escapes])
        left = left[~found]
    if len(left):
        out[left] -= np.log10(256.0 - levels[0].d.sum())
    return out


def _by_end(steps: DataFrame) -> DataFrame:
    """(k, n, steps): order-two counts: for each last two context bytes and symbol its training count and its distinct steps by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]

        def merge() -> None:
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [np.bincount(at, np.concatenate(x), len(unique)) for x in (counts, rows)]
            keys[:], counts[:], rows[:] = [unique], [sums[0]], [sums[1]]

        for b in batches:
            for data in b.column(0):
                k, c = read_steps(data.as_py())
                keys.append(k & MASKS[3])
                counts.append(c.astype(np.float64))
                rows.append(np.ones(len(k)))
                merge()
        k, c, r = keys[0], np.concatenate(counts), np.concatenate(rows)
        for at in range(0, len(k), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(c[part].astype(np.int64)), pa.array(r[part].astype(np.int64))], ["k", "n", "steps"])

    return steps.select("data").mapInArrow(run, "k long, n long, steps long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("steps").alias("steps"))


class Deal:
    """Which bucket a step goes to; ``hot``: two-byte ends that are dealt by three bytes, with their counts."""

    def __init__(self, buckets: int, ends: pd.DataFrame, hot_keys: np.ndarray, hot_counts: np.ndarray):
        self.buckets = buckets
        self.hot = np.zeros(1 << 16, bool)
        self.hot[ends["end"].to_numpy(np.int64)] = True
        self.hot_keys, self.hot_counts = hot_keys, hot_counts

    def bucket(self, key: np.ndarray) -> np.ndarray:
        end = key >> 8 & 0xFFFF
        which = np.where(self.hot[end], key >> 8 & MASKS[3] | 1 << 24, end).astype(np.uint64)
        return ((which * np.uint64(_MIX) >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def order(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps by bucket and, within, as they were; and the buckets' edges."""
        bucket = self.bucket(key)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(self.buckets + 1))


def step_answers(steps: DataFrame, buckets: int) -> tuple[DataFrame, Deal]:
    """(block, bucket, data) for EXTRA rows: the costs of a block's steps of a bucket, and how steps were dealt."""
    by_end = store(_by_end(steps), "ppm-ends")
    low = by_end.filter("n > 0").groupBy(F.expr("k & 65535").alias("k")).agg(F.sum("n").alias("n")).toPandas()  # at most 256 * 256 rows
    ends = by_end.groupBy(F.expr("k >> 8").alias("end")).agg(F.sum("steps").alias("steps"))
    share = max(1, (by_end.agg(F.sum("steps")).first()[0] or 0) // buckets)
    hot_ends = ends.filter(F.col("steps") > share).select("end").toPandas()  # fewer than buckets
    hot = by_end.filter("n > 0").join(F.broadcast(steps.sparkSession.createDataFrame(hot_ends, "end long")), F.expr("k >> 8 = end"), "left_semi").select("k", "n").toPandas()
    deal = Deal(buckets, hot_ends, hot["k"].to_numpy(np.int64), hot["n"].to_numpy(np.float64))
    pair_keys, pair_counts = low["k"].to_numpy(np.int64), low["n"].to_numpy(np.float64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                key, count = read_steps(data.as_py())
                order, edges = deal.order(key)
                full = np.flatnonzero(np.diff(edges)).tolist()
                mine = [order[edges[k] : edges[k + 1]] for k in full]
                packed = [words.join(words.squeeze(np.diff(key[m], prepend=0)), words.squeeze(count[m])) for m in mine]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(packed, pa.binary())], ["block", "bucket", "data"])

    def cost(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [read_steps(x) for x in rows["data"]]
        n = [len(k) for k, _ in parts]
        unique, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(unique))
        levels = {0: Level(pair_keys & 255, pair_counts), 1: Level(pair_keys, pair_counts)}
        whole = ~deal.hot[unique >> 8 & 0xFFFF]
        levels[2] = Level(np.r_[unique[whole] & MASKS[3], deal.hot_keys], np.r_[counts[whole], deal.hot_counts])
        for order in range(3, ORDER + 1):
            levels[order] = Level(((unique >> 8 & MASKS[order]) << 8) | (unique & 255), counts)
        costs = step_costs(unique, levels)[at]
        ends = np.cumsum(n)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "data": [words.squeeze(-costs[z - k : z]) for k, z in zip(n, ends, strict=True)]})

    spread = steps.select("block", "data").mapInArrow(dealt, "block long, bucket int, data binary")
    return spread.groupBy("bucket").applyInPandas(cost, "block long, bucket int, data binary"), deal


def word_counts(of_words: DataFrame) -> DataFrame:
    """(block, bucket, data, n, v): a block's words of a bucket with their counts in all blocks; n and v: the bucket's occurrences and distinct words, in its first row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [words.read_words(x) for x in rows["data"]]
        total: dict[bytes, int] = {}
        for own, counts in parts:
            for w, c in zip(own, counts.tolist(), strict=True):
                total[w] = total.get(w, 0) + c
        data = [words.squeeze(np.fromiter(map(total.__getitem__, own), np.int64, len(own))) for own, _ in parts]
        n, v = sum(total.values()), sum(c > 0 for c in total.values())
        first = [1] + [0] * (len(parts) - 1)
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "data": data, "n": [n * f for f in first], "v": [v * f for f in first]})

    return of_words.groupBy("bucket").applyInPandas(run, "block long, bucket int, data binary, n long, v long")


def scored(docs: DataFrame, test: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; rows with ``test`` true are not learnt from."""
    buckets = words.bucket_count(docs, text)
    table = words.coded(docs, _splitter, ~test, "ppm-words", buckets, key, text, extra=_steps, block_chars=BLOCK_CHARS)
    counts = store(word_counts(words.words_of(table)), "ppm-counts")
    row = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train = table.select(F.explode("flag").alias("flag")).filter("flag").count()
    total, kinds = (row["n"] or 0) + n_train, (row["v"] or 0) + (n_train > 0)
    costs, deal = step_answers(table.filter(F.col("kind") == words.EXTRA).select("block", "data"), buckets)
    answers = counts.select("block", "bucket", F.lit(words.WORDS).alias("kind"), "data").unionByName(costs.select("block", "bucket", F.lit(words.EXTRA).alias("kind"), "data"))

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        place, data = words.by_number(rows, answers[answers["kind"] == words.WORDS])
        c = np.concatenate([np.empty(0, np.int64), *(words.unsqueeze(x).astype(np.int64) for x in data)])[place]
        own = rows[rows["kind"] == words.WORDS].sort_values("at")
        by_place = [w for x in own["data"] for w in words.read_words(x)[0]]
        book = Book([by_place[i] for i in place.tolist()])
        keys, _ = read_steps(rows[rows["kind"] == words.EXTRA]["data"].iloc[0])
        order, _ = deal.order(keys)
        cost = np.empty(len(keys))
        cost[order] = np.concatenate([np.empty(0), *(-words.unsqueeze(x, "<f8") for x in answers[answers["kind"] == words.EXTRA].sort_values("bucket")["data"])])
        finder = Finder(keys)
        base = np.log10((c + 1) / (total + kinds + 1))
        end_base, known = np.log10((n_train + 1) / (total + kinds + 1)), c > 0
        frames = []
        for doc_ids, flags, sizes, numbers in words.documents_of(rows):
            ends = np.cumsum(sizes)
            texts = [numbers[a:z] for a, z in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            score = np.zeros(len(texts))
            for some, key, n in batches(texts, book):
                z = np.cumsum(n)
                score[some] += np.add.reduceat(cost[finder.find(key)], z - n)
            frames.append(pd.DataFrame({
                "doc_id": pd.array(doc_ids, "Int64"), "held_out": [not f for f in flags], "n_tokens": sizes + 1,
                "n_known": [int(known[t].sum()) + (n_train > 0) for t in texts], "train_tokens": total,
                "base_score": [float(base[t].sum()) + end_base for t in texts], "score": score,
            }))
        return pd.concat(frames)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
