"""Cosine join of vectors within labels: epsilon grid order.

Unit vectors of cosine >= c are at most eps = sqrt(2 - 2c) apart.  Vectors are
sorted by label and by the cells, eps wide, of their coordinates on the leading
principal axes; the sequence is cut into blocks of a fixed size.  Intervals of
the sequence are nodes of a tree of FAN children.  The join starts with each
label's whole sequence against itself and goes down level by level: a pair of
intervals whose boxes (coordinates, and the length of what the axes leave out)
are provably more than eps apart is skipped, any other is replaced by the pairs
of its children.  Each level is two equality joins, so the recursion runs on all
executors.  Pairs of blocks that remain are compared, again leaf by leaf, by
matrix products in double precision; block pairs that are provably near as a
whole (centres and radii) are counted without comparing.

A task emits the number of links of each vector and a spanning forest of the
links, never the pairs, so groups of near copies cost their comparisons and
yield their size.  Equal vectors are one row with a count before the join.

How much can be skipped depends on the data: axes that carry little of the
variance separate little, and within a label of such vectors the comparisons
grow with the square of its size.

Defined cases: a null label, and a vector that is null, empty, zero or holds
null or non-finite components, links with nothing.  Vectors of different length
do not link.  Rows that repeat a vec_id are vectors of their own; vec_id may be
null (component_id is then the smallest other one, kept is false).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, store
from .components import connected_components
from .simhash import _Forest

#: Leading principal axes, and the coordinates that they are taken from at most.
AXES = 8
MOST_COORDINATES = 256
#: Bytes of a block's vectors, rows of a leaf inside it, children of an interval.
BLOCK_BYTES = 1 << 21
LEAF = 256
FAN = 4
#: What rounding can add to a squared distance.
SLACK = 1e-9


def unit_vectors(rows: pa.Array) -> list[bytes | None]:
    """Each vector scaled to length 1, as little-endian doubles; None where it has no direction."""
    out: list[bytes | None] = [None] * len(rows)
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        mine = np.flatnonzero(size == d)
        x = flat[start[mine, None] + np.arange(d)]
        most = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (most > 0)
        x = x[ok] / most[ok, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0  # no negative zero: equal vectors are equal bytes
        for k, row in zip(mine[ok].tolist(), x, strict=True):
            out[k] = row.tobytes()
    return out


def matrix(units: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), d)


def principal_axes(distinct: DataFrame, d: int) -> np.ndarray:
    """(d, AXES) orthonormal axes of most variance, from the second moments of all vectors of length d."""
    used = min(d, MOST_COORDINATES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((used, used)), np.zeros(used), 0
        for b in batches:
            x = matrix(b.column(0).to_pylist(), d)[:, :used]
            total, mean, n = total + x.T @ x, mean + x.sum(axis=0), n + len(x)
        if n:
            whole = np.vstack([total, mean, np.r_[float(n), np.zeros(used - 1)]])
            at = np.indices(whole.shape)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].ravel(), pa.int32()), pa.array(at[1].ravel(), pa.int32()), pa.array(whole.ravel(), pa.float64())], ["i", "j", "s"])

    sums = distinct.filter(F.octet_length("unit") == 8 * d).select("unit").mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    whole = np.zeros((used + 2, used))
    for r in sums.toLocalIterator():  # used * (used + 2) sums, however many vectors there are
        whole[r["i"], r["j"]] = r["s"]
    n = max(whole[-1, 0], 1.0)
    spread = whole[:used] / n - np.outer(whole[used], whole[used]) / n**2
    axes = np.zeros((d, min(AXES, used)))
    axes[:used] = np.linalg.eigh(spread)[1][:, ::-1][:, : axes.shape[1]]
    return axes


def coordinates(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """AXES coordinates of each unit vector and the length of the rest; without known axes, its first components."""
    d = x.shape[1]
    c = x @ axes[d] if d in axes else x[:, :AXES]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (c * c).sum(axis=1)))
    return np.c_[c, np.zeros((len(x), AXES - c.shape[1])), rest]


def cells(c: np.ndarray, width: float) -> list[bytes]:
    """The grid cell of each row of coordinates, as bytes that sort like the cells, first axis first."""
    number = np.floor(c[:, :AXES] / width).clip(-(1 << 31), (1 << 31) - 1) + (1 << 31)
    return [row.tobytes() for row in number.astype(">u4")]


def blocks_in_order(distinct: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """The sequence of ``distinct`` (id, label, unit, copies) in grid order, cut into numbered blocks of one label and length."""
    spark = distinct.sparkSession

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = b.column(b.schema.get_field_index("unit")).to_pylist()
            out: list[bytes | None] = [None] * len(units)
            by_size: dict[int, list[int]] = {}
            for k, u in enumerate(units):
                by_size.setdefault(len(u) // 8, []).append(k)
            for d, mine in by_size.items():
                for k, cell in zip(mine, cells(coordinates(matrix([units[k] for k in mine], d), axes), eps), strict=True):
                    out[k] = cell
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "cell"])

    label = distinct.schema["label"].dataType.simpleString()
    rows = distinct.select("id", "label", "unit", "copies", F.octet_length("unit").alias("bytes"))
    order = ["label", "bytes", "cell", "id"]
    dealt = rows.mapInArrow(placed, f"id long, label {label}, unit binary, copies long, bytes int, cell binary").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            d = held[0][3] // 8
            x = matrix([r[2] for r in held], d)
            box = coordinates(x, axes)
            centre = x.mean(axis=0)
            radius = math.sqrt(((x - centre) ** 2).sum(axis=1).max()) * (1 + SLACK)
            ids, copies = [r[0] for r in held], [r[4] for r in held]
            data = [part, number, held[0][1], d, ids, copies, sum(copies), box.min(axis=0).tolist(), box.max(axis=0).tolist(), centre.tolist(), radius, x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(data, fields, strict=True)], schema=fields)

        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        fields = None
        for b in batches:
            if fields is None:
                kinds = [pa.int32(), pa.int64(), b.schema.field("label").type, pa.int32(), longs, longs, pa.int64(), doubles, doubles, doubles, pa.float64(), pa.binary()]
                fields = pa.schema(list(zip(BLOCK_COLUMNS, kinds, strict=True)))
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "label", "unit", "bytes", "copies")), strict=True):
                if held and ((held[0][1], held[0][3]) != (row[1], row[3]) or len(held) * row[3] >= BLOCK_BYTES):
                    yield block()
                    held, number = [], number + 1
                held.append(row)
        if held:
            yield block()

    schema = f"part int, number long, label {label}, d int, ids array<long>, copies array<long>, weight long, lo array<double>, hi array<double>, centre array<double>, radius double, x binary"
    made = store(dealt.mapInArrow(cut, schema), "grid-blocks")
    # blocks before a part's first one: a row a partition
    starts = made.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return made.join(F.broadcast(starts), "part").withColumn("block", F.col("before") + F.col("number")).drop("part", "number", "before")


BLOCK_COLUMNS = ("part", "number", "label", "d", "ids", "copies", "weight", "lo", "hi", "centre", "radius", "x")


def _gap(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """Squared distance of two boxes."""
    total = F.lit(0.0)
    for k in range(AXES + 1):
        apart = F.greatest(F.lit(0.0), F.col(lo)[k] - F.col(other_hi)[k], F.col(other_lo)[k] - F.col(hi)[k])
        total = total + apart * apart
    return total


def near_blocks(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks that may hold vectors within ``eps``, by recursion over intervals of the sequence."""
    group = ["label", "d"]
    box = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(AXES + 1)]).alias(c)
    levels = [blocks.select(*group, F.col("block").alias("node"), "lo", "hi")]
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most >> (2 * (len(levels) - 1)):
        up = F.floor(F.col("node") / FAN).alias("node")
        levels.append(store(levels[-1].groupBy(*group, up).agg(box(F.min, "lo"), box(F.max, "hi")), "grid-nodes"))
    pairs = levels[-1].select(*group, F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("node") / FAN))
        one = child.select(*group, F.col("up").alias("a"), F.col("node").alias("a1"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        two = child.select(*group, F.col("up").alias("b"), F.col("node").alias("b1"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        both = pairs.join(one, [*group, "a"]).join(two, [*group, "b"]).filter("a1 <= b1").filter(_gap("alo", "ahi", "blo", "bhi") <= eps * eps + SLACK)
        pairs = store(both.select(*group, F.col("a1").alias("a"), F.col("b1").alias("b")), "grid-pairs")
    return pairs.select("a", "b")


def _apart(one: str, two: str) -> Column:
    square = F.aggregate(F.zip_with(one, two, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(square)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the edges (a, b) join, one a node at most."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = new[new]
        if (new == label).all():
            own = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[own], nodes[label[own]]
        label = new


class _Block:
    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: bytes, d: int, axes: dict[int, np.ndarray]):
        self.ids, self.copies = np.asarray(ids, np.int64), np.asarray(copies, np.float64)
        self.x = np.frombuffer(x, "<f8").reshape(-1, d)
        self.links = np.zeros(len(self.ids))
        c = coordinates(self.x, axes)
        at = np.arange(0, len(c), LEAF)
        self.lo, self.hi = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)


def compare_blocks(a: _Block, b: _Block, cosine: float) -> _Forest:
    """Adds up links of both blocks (once if they are one); returns a forest over ids of what is linked."""
    forest = _Forest()
    apart = np.maximum(0.0, np.maximum(a.lo[:, None] - b.hi[None], b.lo[None] - a.hi[:, None]))
    near = (apart * apart).sum(axis=2) <= 2 - 2 * cosine + SLACK
    for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
        if a is b and i > j:
            continue
        one, two = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        hit = a.x[one] @ b.x[two].T >= cosine
        if a is b and i == j:
            hit = hit & hit.T
            np.fill_diagonal(hit, False)
            a.links[one] += hit @ a.copies[one]
            hit = np.triu(hit)
        elif hit.any():
            a.links[one] += hit @ b.copies[two]
            b.links[two] += a.copies[one] @ hit
        at, to = np.nonzero(hit)
        if len(at):
            for x, y in zip(*_spanning(a.ids[one][at], b.ids[two][to]), strict=True):
                forest.join(int(x), int(y))
    return forest


def linked(distinct: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) in parts to be added up, and edges (a, b) that join what all links join, for ``distinct`` (id, label, unit, copies)."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    usual = distinct.groupBy(F.octet_length("unit").alias("n")).count().orderBy(F.desc("count"), "n").first()
    axes = {usual["n"] // 8: principal_axes(distinct, usual["n"] // 8)} if usual else {}
    blocks = blocks_in_order(distinct, axes, eps)
    pairs = near_blocks(blocks, eps)
    ball = blocks.select("block", "centre", "radius", "weight", F.element_at("ids", 1).alias("first"))
    side = lambda s: ball.select(*[F.col(c).alias(f"{s}{'' if c == 'block' else '_' + c}") for c in ball.columns])
    whole = _apart("a_centre", "b_centre") + F.col("a_radius") + F.col("b_radius") <= eps - SLACK
    judged = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_weight", "b_weight", "a_first", "b_first", whole.alias("whole"))
    judged = store(judged, "grid-judged")

    # blocks that are near as a whole: every vector of one has every vector of the other
    way = lambda a, b: F.struct(F.col(a).alias("block"), F.col(f"{b}_weight").alias("weight"), F.col(f"{b}_first").alias("first"), (F.col("a") == F.col("b")).alias("own"))
    ways = judged.filter("whole").select(F.explode(F.array_distinct(F.array(way("a", "b"), way("b", "a")))).alias("w")).select("w.*")
    sums = ways.groupBy("block").agg(F.sum("weight").alias("weight"), F.min("first").alias("anchor"), F.max("own").alias("own"))
    members = blocks.select("block", F.inline(F.arrays_zip("ids", "copies"))).join(sums, "block")
    sure = members.select(F.col("ids").alias("id"), (F.col("weight") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("links"), F.col("anchor").alias("to"))
    hubs = ways.join(sums.select("block", "anchor"), "block").select(F.col("first").alias("id"), F.lit(0).cast("long").alias("links"), F.col("anchor").alias("to"))

    # the other pairs are compared: one group of two blocks each
    sides = judged.filter("not whole").select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    data = sides.join(blocks.select("block", "d", "ids", "copies", "x"), "block")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        made = {r.block: _Block(r.ids, r.copies, r.x, r.d, axes) for r in rows.itertuples()}
        a, b = made[rows["a"].iloc[0]], made[rows["b"].iloc[0]]
        nodes, roots = compare_blocks(a, b, cosine).edges()
        found = [(x.ids[x.links > 0], x.links[x.links > 0].astype(np.int64)) for x in made.values()]
        counts = pd.DataFrame({"id": np.concatenate([f[0] for f in found]), "links": np.concatenate([f[1] for f in found])})
        out = pd.concat([counts, pd.DataFrame({"id": np.array(nodes, np.int64), "links": np.zeros(len(nodes), np.int64), "to": np.array(roots, np.int64)})])
        return out.astype({"to": "Int64"}) if "to" in out else out.assign(to=pd.array([None] * len(out), "Int64"))

    compared = data.groupBy("a", "b").applyInPandas(compare, "id long, links long, to long")
    found = store(compared.unionByName(sure).unionByName(hubs), "grid-links")
    return found.select("id", "links"), found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))


def near_duplicates(vectors: DataFrame, cosine: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for every row: rows of its label linked directly at ``cosine`` or more, the smallest key reachable."""
    kind = vectors.schema[label].dataType.simpleString()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(unit_vectors(b.column(2)), pa.binary())], ["vec_id", "label", "unit"])

    some = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    rows = store(some.mapInArrow(units, f"vec_id long, label {kind}, unit binary"), "grid-vectors")
    known = rows.filter("label is not null and unit is not null")
    distinct = known.groupBy("label", "unit").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    distinct = store(distinct.withColumn("id", F.monotonically_increasing_id()), "grid-distinct")
    counts, edges = linked(distinct.drop("low"), cosine)
    roots = store(connected_components(edges), "grid-groups").withColumnRenamed("node", "id")
    rooted = distinct.join(counts.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(roots, "id", "left")
    rooted = store(rooted.select("label", "unit", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "grid-rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(lows, "root").select("label", "unit", "n_links", "component_id")
    found = known.join(labels, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("label is null or unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.withColumnRenamed("vec_id", key)
