"""Token ids in succinct binary shards: one wavelet matrix a file.

File format: magic ``PLWM0002``; a little-endian uint32 and that many bytes of
JSON header (tokens, docs, levels, how many tokens the same task has written before,
the zeros of each level, the sizes of the next three parts); an index; document ids
(int64) and document token counts (uint32), zstandard-compressed; then for each bit
of a token, highest first, the bits of that level, eight to a byte, in blocks of BLOCK
bits, each compressed by itself or plain where that is no gain.  A level holds the
sequence in the order left by the levels above: zeros first, ones after, each in
their old order.  The index has the size of each block (uint16) and the ones before
it in its level (uint32): with it `StoredMatrix` reads one block a level for an
access, and as many for a rank, wherever in the file the token stands.

Rows are dealt by doc_id ranges and sorted, so shards in name order hold the
documents in ascending doc_id (null first; equal ids by text).  A task writes a
shard whenever ``shard_tokens`` are full, under a temporary name, then renames
it, so a repeated task leaves the same files.

Defined cases: null text is empty and has the end id alone.  An empty table has no shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, partitions, store
from .tokens import encoder

MAGIC = b"PLWM0002"
BLOCK = 8192
MOST_IDS = 1 << 20
SHARD_TOKENS = 2_000_000
STEP = 512


class WaveletMatrix:
    """A sequence as bit planes: access, count, rank, select and occurrences without decoding it."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.levels, self.planes = n, len(planes), planes
        self.zeros = [n - int(np.bitwise_count(p).sum()) for p in planes]
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        planes, x = [], values.astype(np.uint32 if levels > 16 else np.uint16)
        for level in range(levels - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            if level:
                up = np.empty_like(x)
                zeros = len(x) - int(np.count_nonzero(bit))
                np.compress(bit, x, out=up[zeros:])
                np.logical_not(bit, out=bit)
                np.compress(bit, x, out=up[:zeros])
                x = up
        return cls(len(values), planes)

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last level up."""
        x = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[~bit] = x[: self.zeros[k]]
            up[bit] = x[self.zeros[k] :] | x.dtype.type(1 << (self.levels - 1 - k))
            x = up
        return x

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of level k."""
        if self._ranks is None:
            self._ranks = []
            for p in self.planes:
                padded = np.zeros(-(-len(p) * 8 // STEP) * STEP // 8, np.uint8)
                padded[: len(p)] = p
                self._ranks.append(np.r_[0, np.cumsum(np.bitwise_count(padded).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64))])
        block = i // STEP
        at = block * STEP // 8
        rest = i - block * STEP
        part = self.planes[k][at : at + (rest >> 3)]
        ones = int(self._ranks[k][block]) + int(np.bitwise_count(part).sum())
        if rest & 7:
            ones += (int(self.planes[k][at + (rest >> 3)]) & ((1 << (rest & 7)) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, upto: int) -> tuple[int, int]:
        lo, hi = 0, upto
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            one = symbol >> (self.levels - 1 - k) & 1
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if one else (lo - a, hi - b)
        return lo, hi

    def _ones_many(self, k: int, i: np.ndarray) -> np.ndarray:
        """As `_ones`, for many positions: counts kept for every byte of the level."""
        plane = self.planes[k]
        upto = np.r_[0, np.cumsum(np.bitwise_count(plane), dtype=np.int64)]
        part = np.r_[plane, np.uint8(0)][i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)
        return upto[i >> 3] + np.bitwise_count(part)

    def access_many(self, i: np.ndarray) -> np.ndarray:
        """The tokens at many positions."""
        value, i = np.zeros(len(i), np.int64), np.asarray(i, np.int64)
        for k in range(self.levels):
            bit = (self.planes[k][i >> 3] >> (i & 7).astype(np.uint8)) & 1
            ones = self._ones_many(k, i)
            value = value << 1 | bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return value

    def rank_many(self, symbol: int, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each of many positions."""
        if symbol >> self.levels:
            return np.zeros(len(upto), np.int64)
        lo, hi = np.zeros(1, np.int64), np.asarray(upto, np.int64)
        for k in range(self.levels):
            a, b = self._ones_many(k, lo), self._ones_many(k, hi)
            one = symbol >> (self.levels - 1 - k) & 1
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if one else (lo - a, hi - b)
        return hi - lo

    def rank(self, symbol: int, upto: int) -> int:
        """How often ``symbol`` stands before position ``upto``."""
        lo, hi = self._range(symbol, upto)
        return hi - lo if symbol >> self.levels == 0 else 0

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _nth(self, k: int, bit: int, nth: int) -> int:
        lo, hi = 0, self.n  # the smallest prefix with nth + 1 such bits
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, symbol: int, nth: int) -> int:
        """Position of occurrence ``nth`` (from 0) of ``symbol``."""
        lo, hi = self._range(symbol, self.n)
        if symbol >> self.levels or not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(self.levels - 1, -1, -1):
            one = symbol >> (self.levels - 1 - k) & 1
            i = self._nth(k, one, i - self.zeros[k] if one else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


class StoredMatrix(WaveletMatrix):
    """The same over a file of which only the blocks that an answer needs are read.

    ``read(at, size)`` returns bytes of the file; ``bytes_read`` adds up what was asked for.
    """

    def __init__(self, read: Callable[[int, int], bytes], blocks_held: int = 256):
        import zstandard

        self._read, self.bytes_read, self._held, self._most = read, 0, {}, blocks_held
        self._plain = zstandard.ZstdDecompressor().decompress
        start = self._get(0, 12)
        size = struct.unpack("<I", start[8:])[0]
        self.header = header_of(start + self._get(12, size))
        self.n, self.levels, self.zeros = self.header["tokens"], self.header["levels"], self.header["zeros"]
        index, ids, counts = self.header["parts"]
        blocks = -(-self.n // BLOCK)
        raw = self._get(12 + size, index)
        self.sizes = np.frombuffer(raw, "<u2", blocks * self.levels).reshape(self.levels, blocks).astype(np.int64)
        self.ones = np.frombuffer(raw, "<u4", offset=2 * blocks * self.levels).reshape(self.levels, blocks).astype(np.int64)
        self.at = 12 + size + index + ids + counts + (np.cumsum(self.sizes) - self.sizes.ravel()).reshape(self.levels, blocks)

    def _get(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self._read(at, size)

    def _block(self, k: int, b: int) -> np.ndarray:
        if (k, b) not in self._held:
            if len(self._held) >= self._most:
                self._held.pop(next(iter(self._held)))
            raw = self._get(int(self.at[k, b]), int(self.sizes[k, b]))
            width = (min(BLOCK, self.n - b * BLOCK) + 7) // 8
            self._held[k, b] = np.frombuffer(raw if len(raw) == width else self._plain(raw), np.uint8)
        return self._held[k, b]

    def _bit(self, k: int, i: int) -> int:
        return int(self._block(k, i // BLOCK)[i % BLOCK >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        b, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.ones[k, b]) if b < self.ones.shape[1] else self.n - self.zeros[k]
        block = self._block(k, b)
        ones = int(self.ones[k, b]) + int(np.bitwise_count(block[: rest >> 3]).sum())
        return ones + ((int(block[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count() if rest & 7 else 0)

    def _nth(self, k: int, bit: int, nth: int) -> int:
        begins = np.arange(self.ones.shape[1]) * BLOCK
        before = self.ones[k] if bit else begins - self.ones[k]
        b = int(np.searchsorted(before, nth, "right")) - 1  # the last block with nth such bits or fewer before it
        bits = np.unpackbits(self._block(k, b), count=min(BLOCK, self.n - b * BLOCK), bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[b])])


def to_bytes(doc_ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, levels: int, before: int = 0) -> bytes:
    """A shard file. doc_ids: int64, the smallest one for null; before: tokens of the same task in earlier files."""
    import zstandard

    if len(tokens) and int(tokens.max()) >> levels:
        raise ValueError(f"an id of {int(tokens.max())} does not fit in {levels} levels")
    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(tokens, levels)
    step, blocks, ones = BLOCK // 8, [], []
    for plane in matrix.planes:
        raw = plane.tobytes()
        pieces = [raw[k : k + step] for k in range(0, len(raw), step)]
        small = [press(p) for p in pieces]
        blocks += [c if len(c) < len(p) else p for c, p in zip(small, pieces, strict=True)]
        each = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), step)) if len(plane) else np.empty(0, np.int64)
        ones.append(np.cumsum(each) - each)
    index = np.array([len(b) for b in blocks], "<u2").tobytes() + np.concatenate([np.empty(0, np.int64), *ones]).astype("<u4").tobytes()
    parts = [index, press(doc_ids.astype("<i8").tobytes()), press(counts.astype("<u4").tobytes())]
    header = json.dumps({"tokens": len(tokens), "docs": len(doc_ids), "levels": levels, "before": before, "zeros": matrix.zeros, "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts, *blocks])


def header_of(data: bytes) -> dict:
    if data[:8] != MAGIC:
        raise ValueError("not a shard file")
    return json.loads(data[12 : 12 + struct.unpack("<I", data[8:12])[0]])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, token counts and the wavelet matrix, whole, of a shard file."""
    import zstandard

    stored = StoredMatrix(lambda at, size: data[at : at + size])
    plain = zstandard.ZstdDecompressor().decompress
    at = 12 + struct.unpack("<I", data[8:12])[0] + stored.header["parts"][0]
    keys, counts = (plain(data[a : a + n]) for a, n in zip((at, at + stored.header["parts"][1]), stored.header["parts"][1:], strict=True))
    width = np.minimum(BLOCK, stored.n - np.arange(stored.sizes.shape[1]) * BLOCK) + 7 >> 3
    planes = []
    for k in range(stored.levels):
        cut = zip(stored.at[k].tolist(), stored.sizes[k].tolist(), width.tolist(), strict=True)
        planes.append(np.frombuffer(b"".join([data[a : a + n] if n == w else plain(data[a : a + n]) for a, n, w in cut]), np.uint8))
    return np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<u4"), WaveletMatrix(stored.n, planes)


NULL_ID = -(1 << 63)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, levels: int = 16, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all rows as shards into ``folder``; returns (shard, n_docs, n_tokens), a row for each file."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        store_at, base = fs.FileSystem.from_uri(folder)
        task, made, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[int] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, keys, tokens, made, before
            name = f"shard-{task:06d}-{made:06d}.plwm"
            counts = np.fromiter((len(x) // 4 for x in ids), np.uint32, len(ids))
            data = to_bytes(np.array(keys, np.int64), counts, np.frombuffer(b"".join(ids), "<u4").astype("<u2" if levels <= 16 else "<u4"), levels, before)
            temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store_at.open_output_stream(temporary) as f:
                f.write(data)
            store_at.move(temporary, f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "n_docs", "n_tokens"])
            ids, keys, tokens, made, before = [], [], 0, made + 1, before + tokens
            return row

        store_at.create_dir(base, recursive=True)
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), enc.encode_many(x.as_py() for x in b.column(1)), strict=True):
                if ids and tokens + len(x) // 4 >= shard_tokens:
                    yield flush()
                keys.append(NULL_ID if k is None else k)
                ids.append(x + end)
                tokens += len(x) // 4 + 1
        if ids:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = rows.repartitionByRange(partitions(spark), "k").sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())
    return dealt.mapInArrow(run, "shard string, n_docs long, n_tokens long")


def read(spark: SparkSession, folder: str, shards: DataFrame, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, first_id, n_end_ids) of every document, from the files in ``folder``.

    ``shards`` is what `write` returned.  A file says what its task wrote
    before it, so only one sum a task is needed: no more rows than partitions.
    The last two columns come by access and rank from the bit planes.
    """
    task = F.element_at(F.split("shard", "-"), 2).cast("int")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = shards.groupBy(task.alias("task")).agg(F.sum("n_tokens").alias("n"))
    starts = store(tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "token-starts")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.plwm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").select(task.alias("task"), "content")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_end_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                keys, counts, matrix = from_bytes(data)
                first += header_of(data)["before"]
                flat = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                crcs = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                ranks = matrix.rank_many(end_id, np.r_[0, ends])
                doc = pa.array(keys, pa.int64(), mask=keys == NULL_ID)
                columns = [starts + first, counts.astype(np.int64), np.array(crcs, np.int64), matrix.access_many(starts), np.diff(ranks)]
                yield pa.RecordBatch.from_arrays([doc, *map(pa.array, columns)], names)

    few = F.broadcast(starts)  # one row a write task, two numbers each
    return files.join(few, "task").select("first", "content").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def occurrences(spark: SparkSession, folder: str, shards: DataFrame, ids: DataFrame, most: int = 10) -> DataFrame:
    """(id, shard, n, first): how often each of ``ids`` (id; distinct) stands in each shard that has it, and its first ``most`` places there.

    Nothing is decoded: a file is opened for its index, and blocks are read for the ranks and selects that the answer needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store_at, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for shard, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store_at.open_input_file(f"{base}/{shard}") as f:
                    matrix = StoredMatrix(lambda at, size, f=f: f.read_at(size, at))
                    for x in wanted:
                        if n := matrix.count(x):
                            rows.append((x, shard, n, [matrix.select(x, k) for k in range(min(n, most))]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "shard", "n", "first"])

    wanted = sorted(r["id"] for r in ids.select("id").distinct().limit(MOST_IDS + 1).collect())
    if len(wanted) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids: no vocabulary has as many")
    asked = shards.select("shard").repartition(partitions(spark)).withColumn("ids", F.array(*[F.lit(x).cast("long") for x in wanted]) if wanted else F.array().cast("array<long>"))
    return asked.mapInArrow(run, "id long, shard string, n long, first array<long>")


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2, levels: int = 16, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents as shards into a new shared folder and reads every document back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-shards")
    shards = store(write(docs, tokenizer, folder, end_id, levels, shard_tokens), "token-manifest")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, n_end_ids long")
    return read(spark, folder, shards, end_id)
