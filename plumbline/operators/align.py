"""Monotone alignment of segments: one-to-one, split, merge, omission, addition.

The recurrence depends on itself cell by cell, which no relational operator
expresses; it runs as one Arrow function over a pair's size and band cells.  Cells
of one anti-diagonal do not need each other, so a step works on a whole diagonal
of many pairs of about the same size.

A pair of long texts goes by itself, in memory that grows with the cells of its
band and with n * sqrt(n + m), not with n * m: the costs of three
diagonals are kept at every so many, and on the way back the choices between two
such places are made again (`align_long`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity
from .stored import met

OPS = ("1:1", "1:2", "2:1", "1:0", "0:1")  # in order of preference on equal cost
#: Segments that each operation takes from either side.
STEPS = {"1:1": (1, 1), "1:2": (1, 2), "2:1": (2, 1), "1:0": (1, 0), "0:1": (0, 1)}


@dataclass(frozen=True)
class Costs:
    omit: float = 0.55
    add: float = 0.55
    split: float = 0.20
    merge: float = 0.20
    floor: float = 0.15
    penalty: float = 0.35


#: Cells of the pairs that are aligned at once; a pair of more is aligned by `align_long`.
GROUP_CELLS = 1 << 20


def _choices(sim: np.ndarray, costs: Costs) -> np.ndarray:
    """[pair, i, j]: which of OPS ends the cheapest way to cell (i, j); ``sim`` is [pair, i, j], zero beyond a pair's size.

    Costs are added in one order, so that ties fall the same everywhere.
    """
    pairs, n, m = sim.shape
    flat = np.concatenate([sim.reshape(pairs, n * m), np.zeros((pairs, 1))], axis=1)  # the last cell stands for none
    choice = np.zeros((pairs, n + 1, m + 1), np.uint8)
    last = [np.full((pairs, n + 1), np.inf) for _ in range(3)]  # diagonals d - 1, d - 2, d - 3 by i
    last[0][:, 0] = 0.0
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        cell = lambda di, dj: flat[:, np.where((i >= di) & (j >= dj), (i - di) * m + (j - dj), n * m)]  # noqa: E731, B023
        before = lambda k, di, dj: np.where((i >= di) & (j >= dj), last[k][:, np.maximum(i - di, 0)], np.inf)  # noqa: E731, B023
        s = cell(1, 1)
        best = before(1, 1, 1) + ((1.0 - s) + np.where(s < costs.floor, costs.penalty, 0.0))
        which = np.zeros(best.shape, np.uint8)
        others = (
            (1, before(2, 1, 2) + ((1.0 - (cell(1, 2) + s) / 2.0) + costs.split)),
            (2, before(2, 2, 1) + ((1.0 - (cell(2, 1) + s) / 2.0) + costs.merge)),
            (3, before(0, 1, 0) + costs.omit),
            (4, before(0, 0, 1) + costs.add),
        )
        for k, total in others:
            better = total < best
            best, which = np.where(better, total, best), np.where(better, np.uint8(k), which)
        choice[:, i, j] = which
        now = np.full((pairs, n + 1), np.inf)
        now[:, i] = best
        last = [now, *last[:2]]
    return choice


def _operation(op: str, i: int, j: int, sim: Callable[[int, int], float]) -> tuple:
    """What ``op`` takes when it ends at (i, j)."""
    di, dj = STEPS[op]
    s = (sim(i - di, j - dj) + sim(i - 1, j - 1)) / 2.0 if di + dj == 3 else sim(i - 1, j - 1) if di and dj else 0.0
    return op, i - di if di else -1, i if di else -1, j - dj if dj else -1, j if dj else -1, float(s)


def _path(n: int, m: int, sim: np.ndarray, choice: np.ndarray) -> list[tuple]:
    out = []
    i, j = n, m
    while i or j:
        op = OPS[choice[i, j]]
        out.append(_operation(op, i, j, lambda a, b: sim[a, b]))
        i, j = i - STEPS[op][0], j - STEPS[op][1]
    return out[::-1]


def _grid(size: tuple[int, int]) -> int:
    return (size[0] + 1) * (size[1] + 1)


class _Diagonals:
    """Steps over anti-diagonals of one pair, with the costs of the last three as all there is to go on from."""

    def __init__(self, n: int, m: int, cells: tuple[np.ndarray, np.ndarray, np.ndarray], costs: Costs):
        self.n, self.m, self.costs = n, m, costs
        i, j, value = (np.asarray(c) for c in cells)
        order = np.argsort(i + j, kind="stable")
        self.i, self.value = i[order], value[order]
        self.start = np.searchsorted((i + j)[order], np.arange(n + m + 1))

    def sims(self, d: int) -> np.ndarray:
        """The similarity of cells (k, d - k) at place k + 2, zero beyond the band."""
        out = np.zeros(self.n + 3)
        if 0 <= d < self.n + self.m:
            own = slice(self.start[d], self.start[d + 1])
            out[self.i[own] + 2] = self.value[own]
        return out

    def first(self) -> list[np.ndarray]:
        """Costs of diagonals 0, -1 and -2 by i, at place i + 2."""
        last = [np.full(self.n + 3, np.inf) for _ in range(3)]
        last[0][2] = 0.0
        return last

    def walk(self, last: list[np.ndarray], begin: int, end: int, choice: np.ndarray | None = None) -> list[np.ndarray]:
        """Costs after diagonals begin..end - 1; ``choice`` gets a row of choices, by i, for each."""
        n, m, c = self.n, self.m, self.costs
        near, far = self.sims(begin - 2), self.sims(begin - 3)
        for d in range(begin, end):
            lo, hi = max(0, d - m), min(n, d) + 1
            at = lambda x, back: x[lo + 2 - back : hi + 2 - back]  # noqa: E731, B023
            i = np.arange(lo, hi)
            j = d - i
            s = at(near, 1)
            best = np.where((i >= 1) & (j >= 1), at(last[1], 1), np.inf) + ((1.0 - s) + np.where(s < c.floor, c.penalty, 0.0))
            which = np.zeros(hi - lo, np.uint8)
            others = (
                (1, np.where((i >= 1) & (j >= 2), at(last[2], 1), np.inf) + ((1.0 - (at(far, 1) + s) / 2.0) + c.split)),
                (2, np.where((i >= 2) & (j >= 1), at(last[2], 2), np.inf) + ((1.0 - (at(far, 2) + s) / 2.0) + c.merge)),
                (3, np.where(i >= 1, at(last[0], 1), np.inf) + c.omit),
                (4, np.where(j >= 1, at(last[0], 0), np.inf) + c.add),
            )
            for k, total in others:
                better = total < best
                best, which = np.where(better, total, best), np.where(better, np.uint8(k), which)
            now = np.full(n + 3, np.inf)
            now[lo + 2 : hi + 2] = best
            if choice is not None:
                choice[d - begin, lo:hi] = which
            last = [now, last[0], last[1]]
            near, far = self.sims(d - 1), near
        return last


def align_long(n: int, m: int, cells: tuple[np.ndarray, np.ndarray, np.ndarray], costs: Costs = Costs()) -> list[tuple]:
    """The operations of one pair, as `align_many` has them, from the cells (i, j, sim) of its band.

    With stretches of the square root of all diagonals, both what is kept of the
    way there and the choices of one stretch take that times the A side.
    """
    steps = _Diagonals(n, m, cells, costs)
    stretch = max(1, int((24 * (n + m)) ** 0.5))
    last, kept = steps.first(), []
    for begin in range(1, n + m + 1, stretch):
        kept.append(last)
        last = steps.walk(last, begin, min(begin + stretch, n + m + 1))
    i, j, value = (np.asarray(c) for c in cells)
    order = np.argsort(i, kind="stable")
    row = np.searchsorted(i[order], np.arange(n + 1))

    def sim(a: int, b: int) -> float:
        own = order[row[a] : row[a + 1]]
        found = own[j[own] == b]
        return float(value[found[0]]) if len(found) else 0.0

    out = []
    a, b = n, m
    for part in reversed(range(len(kept))):
        begin = 1 + part * stretch
        end = min(begin + stretch, n + m + 1)
        choice = np.zeros((end - begin, n + 1), np.uint8)
        steps.walk(kept[part], begin, end, choice)
        while (a or b) and a + b >= begin:
            op = OPS[choice[a + b - begin, a]]
            out.append(_operation(op, a, b, sim))
            a, b = a - STEPS[op][0], b - STEPS[op][1]
    return out[::-1]


def align_many(sizes: list[tuple[int, int]], cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]], costs: Costs = Costs()) -> list[list[tuple]]:
    """For each pair (n, m) with cells (i, j, sim): operations (op, a_start, a_end, b_start, b_end, sim), in order; absent sides are -1.

    Without an A side nothing is emitted, not even additions: the matrix then
    has no row that could tell how many B segments there are.
    """
    out: list[list[tuple]] = [[] for _ in sizes]
    todo = sorted((k for k, (n, _) in enumerate(sizes) if n), key=lambda k: (sizes[k][0] + sizes[k][1], sizes[k]))
    for k in todo:
        if _grid(sizes[k]) > GROUP_CELLS:
            out[k] = align_long(*sizes[k], cells[k], costs)
    todo = [k for k in todo if _grid(sizes[k]) <= GROUP_CELLS]
    while todo:
        size, wide, high = 0, 0, 0
        while size < len(todo):  # as many pairs as have room when all are as large as the largest
            n, m = sizes[todo[size]]
            wide, high = max(wide, n), max(high, m)
            if size and (size + 1) * (wide + 1) * (high + 1) > GROUP_CELLS:
                break
            size += 1
        group, todo = todo[:size], todo[size:]
        n, m = max(sizes[k][0] for k in group), max(sizes[k][1] for k in group)
        sim = np.zeros((len(group), n, m))
        for at, k in enumerate(group):
            i, j, value = cells[k]
            sim[at, i, j] = value
        choice = _choices(sim, costs)
        for at, k in enumerate(group):
            out[k] = _path(*sizes[k], sim[at], choice[at])
    return out


def align(n: int, m: int, cells: dict[tuple[int, int], float], costs: Costs = Costs()) -> list[tuple]:
    """The operations of one pair, from its cells by (i, j)."""
    i, j = (np.fromiter((c[k] for c in cells), np.int64, len(cells)) for k in (0, 1))
    return align_many([(n, m)], [(i, j, np.fromiter(cells.values(), np.float64, len(cells)))], costs)[0]


def operations(sizes: DataFrame, scored: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(pair_id, lang, n, m, op_idx, op, a_start, a_end, b_start, b_end, sim) of every pair, empty sides included."""
    cells = scored.groupBy("pair_id").agg(F.collect_list(F.struct("i", "j", "sim")).alias("cells"))
    return operations_of(sizes.join(cells, "pair_id", "left"), costs)


_NAMES = ["pair_id", "lang", "n", "m", "op_idx", "op", "a_start", "a_end", "b_start", "b_end", "sim"]
_TYPES = [*[pa.int32()] * 3, pa.string(), *[pa.int32()] * 4, pa.float64()]
_SCHEMA = "lang string, n int, m int, op_idx int, op string, a_start int, a_end int, b_start int, b_end int, sim double"


def _aligned(ids: pa.Array, langs: pa.Array, dims: list[tuple[int, int]], cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]], costs: Costs) -> pa.RecordBatch:
    """Rows of `operations` for some pairs."""
    found = align_many(dims, cells, costs)
    pick = pa.array(np.repeat(np.arange(len(dims)), [len(f) for f in found]))
    rows = [(*dims[k], x, *op) for k, f in enumerate(found) for x, op in enumerate(f)]
    return pa.RecordBatch.from_arrays([ids.take(pick), langs.take(pick), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]], _NAMES)


def operations_of(matrix: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """As `operations`, from a row a pair: ``matrix`` (pair_id, lang, n, m, cells); nothing is shuffled."""
    kind = matrix.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column(4)
                counts = np.array([c or 0 for c in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ends = np.cumsum(counts)
                i, j, sim = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                parts = [(i[z - c : z], j[z - c : z], sim[z - c : z]) for c, z in zip(counts.tolist(), ends.tolist(), strict=True)]
                dims = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
                yield _aligned(b.column(0), b.column(1), dims, parts, costs)

    few = F.transform("cells", lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), c["sim"].alias("sim"))).alias("cells")
    return matrix.select("pair_id", "lang", "n", "m", few).mapInArrow(run, f"pair_id {kind}, {_SCHEMA}")


def operations_from(segments: DataFrame, seed: int = 0, costs: Costs = Costs(), width: float = 0.2, near: int = 2) -> DataFrame:
    """As `operations_of` of `similarity.matrix`, straight from segments: a pair's cells are arrays of one step and never rows, GROUP_CELLS or one pair at a time."""
    kind = segments.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in similarity.few(batches):
            dims, cells, full = [], [], 0
            for k, (n, m, found) in enumerate(similarity.stretches(part, seed, width, near)):
                few = [(i.astype(np.int32), j.astype(np.int32), similarity.exact_scores(value, hashes)[1]) for i, j, value, hashes in found]
                cells.append(tuple(np.concatenate(x) for x in zip(*few, strict=True)) if few else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)))
                dims.append((n, m))
                full += len(cells[-1][0])
                if full >= GROUP_CELLS or k + 1 == part.num_rows:
                    begin = k + 1 - len(dims)
                    yield _aligned(part.column(0).slice(begin, len(dims)), part.column(1).slice(begin, len(dims)), dims, cells, costs)
                    dims, cells, full = [], [], 0

    return similarity.by_pair(segments).mapInArrow(run, f"pair_id {kind}, {_SCHEMA}")


def histogram(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n_ops"))


def coverage(ops: DataFrame) -> DataFrame:
    """(pair_id, a_complete, b_complete, n_ops): whether the operations cover each segment once and in order."""

    def complete(side: str, size: str) -> Column:
        spans = F.sort_array(F.collect_list(F.when(F.col(f"{side}_start") >= 0, F.struct("op_idx", f"{side}_start", f"{side}_end"))))
        used = F.flatten(F.transform(spans, lambda x: F.sequence(x[f"{side}_start"], x[f"{side}_end"] - 1)))
        want = F.when(F.max(size) > 0, F.sequence(F.lit(0), F.max(size) - 1)).otherwise(F.array().cast("array<int>"))
        return used == want

    return ops.groupBy("pair_id").agg(complete("a", "n").alias("a_complete"), complete("b", "m").alias("b_complete"), F.count(F.lit(1)).alias("n_ops"))


def op_tokens(ops: DataFrame, segments: DataFrame) -> DataFrame:
    """(pair_id, op_idx, side, lo, hi): the tokens lo..hi - 1 of each side that an operation covers; none of an absent side."""
    parts = []
    for side in "ab":
        covered = ops.filter(f"{side}_start >= 0").select("pair_id", "op_idx", F.lit(side).alias("side"), F.explode(F.expr(f"sequence({side}_start, {side}_end - 1)")).alias("seg"))
        parts.append(covered)
    s = segments.select("pair_id", "side", "seg", "tok_lo", "tok_hi")
    j = met(parts[0].unionByName(parts[1]), s, ["pair_id", "side", "seg"])
    return j.groupBy("pair_id", "op_idx", "side").agg(F.min("tok_lo").alias("lo"), F.max("tok_hi").alias("hi"))
