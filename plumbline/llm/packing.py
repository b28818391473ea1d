"""Best-fit packing of token sequences by hierarchical residual rounds.

Documents are encoded (end id appended) and cut only where they are longer than
a sequence.  Pieces are dealt over tasks and packed there, largest first, each
into the fullest bin that holds it.  Bins that are nearly full are done; the
others are the items of the next round, in ``fan_in`` times fewer tasks, until
one task is left, or as few as hold ``per_task`` items each.  A round writes
where each item went; a piece's place is the sum along its chain of bins.

Defined cases: null text is empty and is one piece holding the end id.  Rows of
one doc_id, or of null doc_id, are packed each for itself.  No rows: no
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .tokens import encoder

CAPACITY = 2048
PER_TASK = 200_000
FAN_IN = 8
NEARLY_FULL = 0.995


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc_id, piece, start, length, ids_crc32): a row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        item = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_many(x.as_py() for x in b.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out, (item, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
                    item += 1
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["item", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the use of each bin: largest first, into the fullest bin that holds it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    mask = 0  # which of those lists hold any
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _round(items: DataFrame, level: int, groups: int, capacity: int) -> DataFrame:
    """(item, bin, at, used): one round over items (item, size) dealt over ``groups`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("size", "descending"), ("item", "ascending")])
        sizes = t.column("size").to_numpy()
        bins, offsets, used = best_fit(sizes, capacity)
        first = (level + 1 << 56) | (TaskContext.get().partitionId() << 32)
        arrays = [t.column("item").combine_chunks(), pa.array(bins + first), pa.array(offsets), pa.array(used[bins])]
        yield from pa.Table.from_arrays(arrays, ["item", "bin", "at", "used"]).to_batches(max_chunksize=1 << 16)

    return items.repartition(groups, "item").mapInArrow(run, "item long, bin long, at long, used long")


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PER_TASK, fan_in: int = FAN_IN, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """(item, sequence_id, offset) for items (item, size) of at most ``capacity``."""
    n = items.count()
    groups = max(1, -(-n // per_task))
    rounds: list[DataFrame] = []
    todo = items
    while True:
        done = store(_round(todo, len(rounds), groups, capacity), f"packing-round{len(rounds)}")
        rounds.append(done)
        if groups == 1:
            break
        under = done.filter(F.col("used") < int(capacity * nearly_full)).groupBy("bin").agg(F.max("used").alias("size"))
        todo = under.withColumnRenamed("bin", "item")
        fewer = max(1, -(-groups // fan_in), -(-todo.count() // per_task))
        if fewer >= groups:
            break
        groups = fewer
    place = rounds[0].select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    for r in rounds[1:]:
        up = r.select(F.col("item").alias("sequence_id"), "bin", "at")
        place = place.join(up, "sequence_id", "left").select(
            "item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset")
        )
    return place


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    p = store(pieces(docs, tokenizer, end_id, capacity, key, text), "packing-pieces")
    place = pack(p.select("item", F.col("length").alias("size")), capacity)
    return p.join(place, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
