"""SimHash near-duplicate groups by deletion-variant signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; shingles of
consecutive words, repeats included, are hashed with XXH64 (seed 42).  A
fingerprint bit is set where more than half the hashes have it.

Two 64-bit fingerprints that differ in at most d bits agree but for one bit in
one of d // 2 + 1 segments.  Each segment is therefore indexed under all its
variants with one bit masked, 64 keys a fingerprint: fingerprints whose segment
differs in one bit at most share a key.  Equal keys are brought together and
the full distance is verified.  Inside a large bucket the check walks from
fingerprint to fingerprint and emits a spanning tree of the links, so a large
group of copies costs and yields its size, not its square; no link is lost to
the groups.  Equal fingerprints are collapsed before the index.

Defined cases: a text without words (null, empty) has fingerprint zero, which
links as any other.  Texts with fewer words than a shingle are one shingle.
Repeated rows keep a row each.  Rows of null doc_id get a fingerprint; a group
of nothing else has component_id null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store
from .components import connected_components

BITS = 64
SHORT_RUN = 8
#: Leading bits of a shingle hash that count how common it is.
CELL_BITS = 18
#: Most bits of a set's parity bitmap; smaller sets have two to four bits a hash.
MOST_PARITIES = 1 << 14
#: Keys of a set under which nodes meet first, so that large groups are known before all keys are used.
SEEDS = 3


def text_fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(words) - shingle + 1].tolist()
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [text_fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variant_keys(distance: int) -> Column:
    """Array of 64 keys of column fp: for each bit, its segment without that bit, and which bit."""
    segments = distance // 2 + 1
    edges = [BITS * k // segments for k in range(segments + 1)]
    if max(b - a for a, b in zip(edges, edges[1:])) > 56:
        raise ValueError("a distance of 2 or more is needed")
    keys = []
    for lo, hi in zip(edges, edges[1:]):
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << (bit - lo)))).bitwiseOR(F.lit(bit << 57)) for bit in range(lo, hi)]
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


class _Forest:
    """Union-find over the links of one task; `edges` gives each node's root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p] if p in up else p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one, cut so that a key's rows stay together."""
    held: list[np.ndarray] = []
    for b in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if len(held[0]) and (cut := int(np.searchsorted(held[0], held[0][-1]))):  # the last key may go on
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield held


def run_pairs(key: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """(rows, rows) of pairs within ``distance`` in each run of one key.

    Runs of up to SHORT_RUN rows give all such pairs; longer ones as many as
    join what all pairs would join: a walk that starts at the run's most central
    fingerprint.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    for s, n in zip(start[size > SHORT_RUN].tolist(), size[size > SHORT_RUN].tolist(), strict=True):
        own = fp[s : s + n]
        some = own[:: max(1, n // 64)]
        spread = sum((_popcount(own ^ x).astype(np.int64) for x in some), np.zeros(n, np.int64))
        todo = np.argsort(spread, kind="stable")
        found: list[tuple[int, int]] = []
        while len(todo) > 1:
            front, todo = [int(todo[0])], todo[1:]
            while front and len(todo):
                at = front.pop(0)
                near = _popcount(own[todo] ^ own[at]) <= distance
                hit = todo[near].tolist()
                found += [(at, h) for h in hit]
                front += hit
                todo = todo[~near]
        if found:
            yield np.array(found, np.int64).T + s
    short = np.repeat(size <= SHORT_RUN, size)
    for gap in range(1, SHORT_RUN):
        at = np.flatnonzero((key[gap:] == key[:-gap]) & short[gap:])
        at = at[_popcount(fp[at] ^ fp[at + gap]) <= distance]
        if len(at):
            yield np.stack([at, at + gap])


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): links of distinct fingerprints (column fp) whose components are those of all pairs within ``distance``."""
    keyed = distinct.select(F.explode(variant_keys(distance)).alias("key"), "fp")
    dealt = keyed.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for key, fp in whole_keys(batches):
            for one, two in run_pairs(key, fp, distance):
                for a, b in zip(fp[one].tolist(), fp[two].tolist(), strict=True):
                    forest.join(a, b)
        a, b = forest.edges()
        for at in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)], pa.int64()), pa.array(b[at : at + (1 << 16)], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links."""
    fps = store(fingerprints(docs, shingle, key, text), "simhash-fingerprints")
    nodes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    groups = store(connected_components(links(nodes.select("fp"), distance)), "simhash-groups")
    rooted = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = store(rooted.join(lows, "root").select("fp", "component_id"), "simhash-labels")
    return fps.join(labels, "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of shingles, in ascending order; none for no words."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - shingle + 1].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def prefix(hashes: np.ndarray, similarity: float, weight: np.ndarray) -> np.ndarray:
    """The keys of a set: its first n - ceil(similarity * n) + 1 hashes, those of light cells first.

    Two sets of that similarity share ceil(similarity * n) hashes or more, so
    whatever order all sets are sorted in, they share one of these.
    """
    n = len(hashes)
    order = np.argsort(weight[hashes >> np.uint64(64 - CELL_BITS)], kind="stable")
    return hashes[order[: n - math.ceil(similarity * n - 1e-9) + 1]]


def parities(hashes: np.ndarray) -> bytes:
    """Bitmap of a power of two bits: whether an odd number of hashes end in a bit's number."""
    bits = min(MOST_PARITIES, max(64, 1 << (2 * len(hashes)).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Parities:
    """Parity bitmaps of several sets. Two sets differ in as many hashes as their bitmaps, folded to one length, differ in bits, at least."""

    def __init__(self, bitmaps: list[bytes]):
        self.n = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps)) // 8
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(bitmaps), "<u8")

    def _folded(self, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(rows), n), np.uint64)
        own = self.n[rows]
        for wide in np.unique(own).tolist():
            mine = own == wide
            x = self.flat[self.at[rows[mine], None] + np.arange(wide)]
            out[mine] = x if wide == n else np.bitwise_xor.reduce(x.reshape(-1, wide // n, n), axis=1)
        return out

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        least = np.minimum(self.n[one], self.n[two])
        out = np.empty(len(one), np.int64)
        for n in np.unique(least).tolist():
            mine = np.flatnonzero(least == n)
            for cut in range(0, len(mine), 1 << 12):
                at = mine[cut : cut + (1 << 12)]
                out[at] = np.bitwise_count(self._folded(one[at], n) ^ self._folded(two[at], n)).sum(axis=1, dtype=np.int64)
        return out


class _Cells:
    """How often a task sees each cell of shingle hashes, over all its texts."""

    def __init__(self) -> None:
        self.total = np.zeros(1 << CELL_BITS, np.int64)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int32))
        self.n += len(hashes)
        if self.n >= 1 << CELL_BITS:
            self._count()

    def _count(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=1 << CELL_BITS)
        self.held, self.n = [], 0

    def heavy(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells seen far more often than most, and how often: what the others lack is under the bound."""
        self._count()
        cells = np.flatnonzero(self.total > 4 * self.total.mean() + 16)
        return cells, self.total[cells]


def may_meet(size: np.ndarray, place: np.ndarray, one: np.ndarray | int, two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows of one key can have the similarity if this key is the first that their sets share.

    The sets then share this key and, at most, what follows it in the shorter
    rest.  A pair that has the similarity passes in the bucket of its first shared key.
    """
    need = np.ceil((size[one] + size[two]) * (similarity / (1 + similarity)) - 1e-6)
    return np.minimum(size[one] - place[one], size[two] - place[two]) >= need


def may_link(size: np.ndarray, bitmaps: _Parities, one: np.ndarray, two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows can have the similarity, by their bitmaps: never false for one that has it."""
    return bitmaps.apart(one, two) <= (size[one] + size[two]) * ((1 - similarity) / (1 + similarity)) + 1e-6


class _Bucket:
    """Rows of one key or more, sorted by key, and which of their pairs are worth a comparison."""

    def __init__(self, key: np.ndarray, node: np.ndarray, spot: np.ndarray, odd: np.ndarray, label: np.ndarray, similarity: float):
        self.key, self.node, self.label, self.similarity = key, node, label, similarity
        self.size, self.place = spot >> 32, spot & 0xFFFFFFFF
        self.bitmaps = _Parities(odd.tolist()) if len(odd) and odd[0] is not None else None

    def worth(self, one: np.ndarray | int, two: np.ndarray) -> np.ndarray:
        fits = (self.label[one] != self.label[two]) & may_meet(self.size, self.place, one, two, self.similarity)
        if self.bitmaps and fits.any():
            at = np.flatnonzero(fits)
            fits[at] = may_link(self.size, self.bitmaps, np.full(len(at), one) if isinstance(one, int) else one[at], two[at], self.similarity)
        return fits

    def pairs(self, hi: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pairs, rows left).

        In each bucket the rows stand in one order, the same in all buckets.
        The first ``hi`` rows are compared with all that follow and have another
        label, until a bucket has given ``most`` pairs a row: alike rows are
        then better told by new labels.  Buckets with rows not compared and
        more than one label are left for a later call, which starts over.  When
        none is left, each two rows of a bucket have been compared or had one label.
        """
        key, node = self.key, self.node
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        none = np.empty((2, 0), np.int64)
        short = np.repeat(count <= SHORT_RUN, count)
        for gap in range(1, SHORT_RUN):
            at = np.flatnonzero((key[gap:] == key[:-gap]) & short[gap:])
            for cut in range(0, len(at), 1 << 14):
                part = at[cut : cut + (1 << 14)]
                part = part[self.worth(part, part + gap)]
                if len(part):
                    yield np.stack([part, part + gap]), none[0]
        for s, n in zip(start[count > SHORT_RUN].tolist(), count[count > SHORT_RUN].tolist(), strict=True):
            own = s + np.argsort(node[s : s + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
            if (self.label[own] == self.label[own[0]]).all():
                continue
            given = 0
            for k in range(n - 1):
                if k == hi or given > most * n:
                    yield none, own
                    break
                for cut in range(k + 1, n, 1 << 14):
                    rest = own[cut : cut + (1 << 14)]
                    rest = rest[self.worth(int(own[k]), rest)]
                    given += len(rest)
                    if len(rest):
                        yield np.stack([np.full(len(rest), own[k]), rest]), none[0]


def _compared(rows: DataFrame, hi: int, most: int, similarity: float, name: str) -> DataFrame:
    """Stored rows for (key, node, spot, odd, label): pairs (a, b) with key null, and the rows (key, a, b: spot) of buckets that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs: list[tuple[int, int]] = []

        def full(rows: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, pairs
            if len(pairs) >= rows and pairs:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))], ["key", "a", "b"])
                pairs = []
            if sum(len(x[0]) for x in held) >= rows and held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["key", "a", "b"])
                held = []

        for key, node, spot, odd, label in whole_keys(batches):
            again = np.r_[False, key[1:] == key[:-1]]
            several = again | np.r_[again[1:], False]
            if not several.any():
                continue
            rows = _Bucket(*(x[several] for x in (key, node, spot, odd, label)), similarity)
            for (one, two), left in rows.pairs(hi, most):
                x, y = np.minimum(rows.node[one], rows.node[two]), np.maximum(rows.node[one], rows.node[two])
                new = [p for p in zip(x.tolist(), y.tolist(), strict=True) if p not in told]
                if len(told) > 200_000:  # spares repeats; a distinct removes all
                    told.clear()
                told.update(new)
                pairs += new
                if len(left):
                    held.append((rows.key[left], rows.node[left], rows.size[left] << 32 | rows.place[left]))
                if len(pairs) >= 20_000:
                    yield from full(20_000)
            yield from full(20_000)
        yield from full(0)

    dealt = rows.select("key", "node", "spot", "odd", "label").repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return store(dealt.mapInArrow(run, "key long, a long, b long"), name)


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode().lower().split()


class _Texts:
    """Rows (doc_id, digest, text), their nodes (distinct word sequences), and the shingle sets of chosen nodes."""

    def __init__(self, docs: DataFrame, shingle: int, similarity: float, broadcast_rows: int):
        self.shingle, self.similarity, self.broadcast_rows = shingle, similarity, broadcast_rows
        text = F.coalesce("text", F.lit(""))
        self.rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), "text")

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            seen = _Cells()
            for b in batches:
                same = []
                for t in b.column(2):  # one text's words at a time
                    words = _words(t)
                    same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    seen.add(shingle_hashes(words, shingle))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], ["doc_id", "digest", "same", "cell", "n"])
            cells, counts = seen.heavy()
            n = len(cells)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())), pa.array(cells, pa.int32()), pa.array(counts, pa.int64())], ["doc_id", "digest", "same", "cell", "n"])

        both = store(self.rows.mapInArrow(sketch, "doc_id long, digest long, same binary, cell int, n long"), "similar-sketches")
        self.seen = both.filter("cell is null").select("doc_id", "digest", "same")
        self.weight = np.zeros(1 << CELL_BITS, np.int64)
        for r in both.filter("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 2^18 rows at most
            self.weight[r["cell"]] = r["n"]
        nodes = self.seen.groupBy("same").agg(F.min(F.struct("doc_id", "digest")).alias("low"))
        self.nodes = store(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "low"), "similar-nodes")  # written once: ids stay

    def sets(self, nodes: DataFrame, make, columns: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
        """(node, columns...): what ``make(hashes)`` gives for the shingle set of each of ``nodes`` (node)."""
        at = self.nodes.select("node", F.col("low.doc_id").alias("_doc"), F.col("low.digest").alias("_digest"))
        at = at.join(nodes, "node", "left_semi")
        at = F.broadcast(at) if nodes.count() <= self.broadcast_rows else at
        texts = self.rows.join(at, (F.col("doc_id") == F.col("_doc")) & (F.col("digest") == F.col("_digest"))).select("node", "text")
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    made = [make(shingle_hashes(_words(t), shingle)) for t in b.column(1)]
                    out = [pa.array([m[k] for m in made], t) for k, (_, t) in enumerate(columns)]
                    yield pa.RecordBatch.from_arrays([b.column(0), *out], ["node", *(c for c, _ in columns)])

        found = texts.mapInArrow(run, f"node long, {schema}")
        first = F.first(F.struct(*[c for c, _ in columns])).alias("x")  # repeated rows are equal
        return found.groupBy("node").agg(first).select("node", "x.*")


def _fingerprint_of(hashes: np.ndarray) -> int:
    """Fingerprint of a shingle set."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = 200_000, distance: int = 4) -> DataFrame:
    """(doc_id, digest, component_id, first): groups of documents whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Rows are told by doc_id and ``digest``, the hash of the text; ``first`` marks
    the row that stands for the group, the one of the smallest doc_id.  Rows of
    equal word sequence are one node.  The first candidates are the fingerprint
    links of the deletion-variant index (`links`) and the nodes that share one of
    their first SEEDS keys.  Fingerprints of so similar sets differ in more bits
    than the index spans, so links they miss are found by `prefix` keys: nodes
    that share a key meet in a bucket, and each two of them that can have the
    similarity are compared by their sets, unless links found before have put
    them into one group.  No link is lost to the groups: the first rows of every
    bucket are compared with all others, and buckets whose rows are not all in
    one group go on to the next rows until none is left.
    """
    texts = _Texts(docs, shingle, similarity, broadcast_rows)
    weight, nodes = texts.weight, texts.nodes

    def index_row(h: np.ndarray) -> tuple:
        return prefix(h, similarity, weight).view(np.int64), len(h), parities(h), _fingerprint_of(h)

    indexed = texts.sets(nodes.select("node"), index_row, [("keys", pa.list_(pa.int64())), ("size", pa.int32()), ("odd", pa.binary()), ("fp", pa.int64())], "keys array<long>, size int, odd binary, fp long")
    index = store(indexed, "similar-index")

    def keyed(keys: Column, odd: Column) -> DataFrame:
        rows = index.select("node", "size", odd.alias("odd"), F.posexplode(keys).alias("place", "key"))
        return rows.select("key", "node", F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("spot"), "odd", F.col("node").alias("label"))

    def pairs_of(found: DataFrame) -> DataFrame:
        return found.filter("key is null").select("a", "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                c = b.slice(at, 1 << 12)
                n = c.num_rows
                size = np.concatenate([c.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4)])
                both = _Parities(c.column(3).to_pylist() + c.column(5).to_pylist())
                hit = pa.array(may_link(size, both, np.arange(n), np.arange(n, 2 * n), similarity))
                yield pa.RecordBatch.from_arrays([c.column(0).filter(hit), c.column(1).filter(hit)], ["a", "b"])

    def sided(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(of.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]), c)
        return pairs

    def ends(pairs: DataFrame) -> DataFrame:
        return store(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-wanted")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that have the similarity. Bitmaps go to the pairs first, in the place of the much larger sets."""
        both = sided(pairs, index, "size", "odd").select("a", "b", "size_a", "odd_a", "size_b", "odd_b")
        pairs = store(both.mapInArrow(near, "a long, b long"), "similar-near")
        sets = store(texts.sets(ends(pairs), lambda h: (h.view(np.int64),), [("set", pa.list_(pa.int64()))], "set array<long>"), "similar-shingles")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        alike = sided(pairs, sets, "set").filter(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared))
        return store(alike.select("a", "b"), "similar-links")

    # first candidates: fingerprints that link, nodes of one fingerprint, nodes that share an early key
    fps = store(index.groupBy("fp").agg(F.min("node").alias("node")), "similar-fingerprints")
    one_of = lambda c: fps.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}"))
    by_bits = links(fps.select("fp"), distance).join(one_of("a"), "a").join(one_of("b"), "b").select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    equal = index.select(F.col("node").alias("b"), "fp").join(fps.withColumnRenamed("node", "a"), "fp").filter("a < b").select("a", "b")
    early = pairs_of(_compared(keyed(F.slice("keys", 1, SEEDS), F.col("odd")), 1, 1, similarity, "similar-seeds"))
    edges = verified(store(by_bits.unionByName(equal).unionByName(early).distinct(), "similar-pairs"))
    groups = store(connected_components(edges), "similar-groups")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.drop("label").join(groups.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))

    hi, most = 4, 4
    rows = labelled(keyed(F.col("keys"), F.lit(None).cast("binary")))
    while True:
        found = _compared(rows, hi, most, similarity, "similar-candidates")
        pairs = store(pairs_of(found).distinct(), "similar-pairs")
        if not pairs.isEmpty() and not (new := verified(pairs)).isEmpty():
            edges = edges.unionByName(new)
            groups = store(connected_components(edges), "similar-groups")
        left = found.filter("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("spot"))
        if left.isEmpty():
            break
        rows = labelled(left.join(index.select("node", "odd"), "node"))
        hi, most = (1 << 10, 4) if hi == 4 else (hi << 4, most << 4)
    rooted = store(nodes.join(groups, "node", "left").select("same", "low", F.coalesce("root", "node").alias("root")), "similar-roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("lowest"))
    of_text = store(rooted.join(lows, "root").select("same", "lowest"), "similar-lowest")
    found = texts.seen.join(of_text, "same")
    return found.select("doc_id", "digest", F.col("lowest.doc_id").alias("component_id"), F.struct("doc_id", "digest").eqNullSafe(F.col("lowest")).alias("first"))


def keep(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` (documents), whole, that stand for their group: those of the smallest doc_id.

    Of rows of one doc_id with different texts in one group, the smallest text
    hash stays; of rows equal in doc_id and text, the smallest in all columns'
    hash.  Rows of null doc_id cannot be told apart and stay.  Up to
    ``broadcast_rows`` rows to remove (counted first) go to every task, more are
    joined by a shuffle.
    """
    found = store(similar(docs, shingle, similarity, broadcast_rows), "simhash-groups-of-documents")
    gone = store(found.filter("not first").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct(), "simhash-gone")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    rows = rows.join(gone, (F.col("id") == F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left_anti")
    twice = store(found.filter("first").groupBy("doc_id", "digest").count().filter("count > 1").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), "simhash-twice")
    if twice.isEmpty():
        return rows.select("row.*")
    same = (F.col("id") == F.col("_doc")) & (F.col("digest") == F.col("_digest"))
    lowest = rows.join(twice, same, "left_semi").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json(F.struct("row")))).alias("row"))
    return rows.join(twice, same, "left_anti").select("row.*").unionByName(lowest.select("row.*"))
