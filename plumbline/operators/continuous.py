"""Rank correlations of continuous values: as many different values as rows.

`evaluate` works on contingency tables, which are small where labels have a few
dozen values.  Scores of an encoder have a value a token.  Here

* average ranks come from a sort by range: a value's rank is what lies before it
  in its partition, and what earlier partitions hold of its group;
* Kendall's tau-b comes from counting inversions.  Both axes are cut into
  ranges.  A pair of rows in different ranges of both axes is counted in a table
  of ranges by ranges; one in the same range of predictions, by the task of that
  range; one in the same range of gold values but not of predictions, by the task
  of that.  Every pair is counted once and none is ever a row.

The values at which ranges are cut are ranges of their own.  A value that many
rows share is such a cut, and the rows of a range of one value need no
comparison with each other, so they are not sent to one task.

Where gold labels have few values, `correlations` takes both from one sort: what
comes earlier is then told by a count for each gold label.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import evaluate
from .stored import stored

#: Rows of a range, about, and ranges of an axis at most.
RANGE_ROWS = 200_000
MOST_RANGES = 1024
#: Cuts of all groups that are sent to every task at most; more are joined by a shuffle.
BROADCAST_VALUES = 1 << 20
#: Gold labels of a group, and of all groups, that `correlations` counts by value; rows that it takes at once.
GOLD_VALUES = 32
ALL_GOLD_VALUES = 1 << 14
CHUNK = 1 << 17


def running(rows: DataFrame, groups: list[str], order: str, *weights: str) -> DataFrame:
    """``rows`` with before_x for each weight x: its sum over the rows of a group that come earlier in ``order`` (different in all rows of a group).

    Rows are sorted by range; only a sum for each partition and group of it meet in a window.
    """
    dealt = rows.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    at = stored(dealt.withColumn("_part", F.spark_partition_id()), "running")
    sums = at.groupBy(*groups, "_part").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    sums = sums.select(*groups, "_part", *[F.coalesce(F.sum(f"_{w}").over(earlier), none).alias(f"_{w}") for w in weights])
    inside = Window.partitionBy(*groups, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = at.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(inside), none) for w in weights}).join(sums, [*groups, "_part"])
    return placed.withColumns({f"before_{w}": F.col(f"before_{w}") + F.col(f"_{w}") for w in weights}).drop("_part", *[f"_{w}" for w in weights])


def so_far(rows: DataFrame, groups: list[str], weight: str) -> DataFrame:
    """``rows`` with before, the sum of ``weight`` over earlier rows of the same group and partition; partitions are sorted by group."""
    schema = StructType([*rows.schema, StructField("before", rows.schema[weight].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            first = np.zeros(b.num_rows, bool)
            for g in groups:
                code = b.column(g).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                first[1:] |= code[1:] != code[:-1]
            w = b.column(weight).to_numpy(zero_copy_only=False)
            total = np.cumsum(w) - w
            start = np.maximum.accumulate(np.where(first, np.arange(b.num_rows), 0))
            before = total - total[start]
            if [b.column(g)[0].as_py() for g in groups] == last:
                before[start == 0] += carried
            last, carried = [b.column(g)[-1].as_py() for g in groups], before[-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, b.schema.field(weight).type)], [*b.schema.names, "before"])

    return rows.mapInArrow(run, schema)


def ranks(cells: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., column, n, rank): average rank of each different value, from ``cells`` (keys..., column, w).

    Values are sorted by range and summed in that order, so they are moved no more; only a sum for each partition and group meets in a window.
    """
    groups = list(keys)
    values = cells.groupBy(*keys, column).agg(F.sum("w").alias("n"))
    dealt = values.repartitionByRange(*keys, column).sortWithinPartitions(*keys, column).withColumn("_part", F.spark_partition_id())
    at = stored(so_far(dealt, groups, "n"), "ranks")
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*groups, "_part").agg(F.sum("n").alias("_n"))
    sums = stored(sums.select(*groups, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")), "rank-shifts")
    placed = at.join(F.broadcast(sums) if sums.count() <= BROADCAST_VALUES else sums, [*groups, "_part"])
    return placed.select(*keys, column, "n", (F.col("before") + F.col("_shift") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, spearman) of ``cells`` (keys..., pred, gold, w); null where constant or under two rows."""
    ranked = {c: ranks(cells, c, *keys).select(*keys, c, F.col("rank").alias(f"_{c}")) for c in ("pred", "gold")}
    j = cells.join(ranked["pred"], [*keys, "pred"]).join(ranked["gold"], [*keys, "gold"])
    return evaluate.pearson(j, F.col("_pred"), F.col("_gold"), *keys)


def cuts(cells: DataFrame, column: str, ranges: int, *keys: str) -> DataFrame:
    """(keys..., column_cuts): values in ascending order that cut a group's rows into about ``ranges`` equal parts, each value once."""
    shares = [k / ranges for k in range(1, ranges)]
    found = F.percentile_approx(column, shares, 20 * ranges)
    return cells.groupBy(*keys).agg(F.array_sort(F.array_distinct(found)).alias(f"{column}_cuts"))


def range_of(value: Column, cuts: Column, ranges: int) -> Column:
    """2k for a value between cut k - 1 and cut k, 2k + 1 for cut k itself: by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    below = F.reduce(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(cuts)) & (F.get(cuts, at + s - 1) < value), at + s).otherwise(at))
    return F.element_at(F.transform(F.array(below), lambda k: 2 * k + F.coalesce(F.get(cuts, k) == value, F.lit(False)).cast("int")), 1)


def ranges_of(values: dict[str, Column], group: Column, known: list[dict[str, np.ndarray]]) -> Column:
    """A struct of `range_of` for each of ``values``: ``known`` has the cuts of every group, by its number.

    Cuts go to the tasks once; as columns they would be copied into every row.
    """
    names = list(values)
    kind = pa.struct([(c, pa.int32()) for c in names])

    def place(group: pa.Array, *columns: pa.Array) -> pa.Array:
        groups, out = group.to_numpy(zero_copy_only=False), []
        for c, column in zip(names, columns, strict=True):
            value = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            at = np.zeros(len(value), np.int32)
            for g in np.unique(groups).tolist():
                own, cut = groups == g, known[g][c]
                v = value[own]
                below = np.searchsorted(cut, v)
                hit = cut[np.minimum(below, len(cut) - 1)] if len(cut) else np.zeros(len(v))
                equal = (below < len(cut)) & ((hit == v) | (np.isnan(hit) & np.isnan(v)))
                at[own] = 2 * below + equal
            out.append(pa.array(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, at), pa.int32()))
        return pa.StructArray.from_arrays(out, fields=list(kind))

    place.__annotations__ = {"group": pa.Array, "columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, "struct<" + ",".join(f"`{c}`:int" for c in names) + ">")(group, *values.values())


def earlier_and_less(place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each element the weight of earlier elements whose ``place`` (from 0, no gaps) is less: one pass over all for each bit."""
    out = np.zeros(len(place), np.int64)
    at = np.arange(len(place))  # elements by leading bits of their place, then in order
    for bit in reversed(range(int(place.max(initial=0)).bit_length())):
        own = place[at]
        group = own >> (bit + 1)
        one = (own >> bit) & 1
        first = np.r_[True, group[1:] != group[:-1]]
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, len(at)])
        low = np.cumsum(weight[at] * (1 - one))
        before = np.repeat(np.r_[0, low][start], size)
        out[at] += np.where(one == 1, low - before, 0)
        zeros = np.cumsum(1 - one)
        rank = zeros - np.repeat(np.r_[0, zeros][start], size)  # zeros of the group up to here
        begin = np.repeat(start, size)
        total = np.repeat(np.add.reduceat(1 - one, start) if len(start) else start, size)
        to = np.where(one == 0, begin + rank - 1, begin + total + (np.arange(len(at)) - begin - rank))
        moved = np.empty_like(at)
        moved[to] = at
        at = moved
    return out


def order_sum(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over pairs of w * w' where x and y order the pair alike, less where they order it opposite ways; exact up to a total weight of 3e9."""
    _, place = np.unique(y, return_inverse=True)
    w = w.astype(np.int64)
    total = 0
    for sign, key in ((1, place), (-1, place.max(initial=0) - place)):
        order = np.lexsort((-key, x))  # of one x, the greater first: what is earlier and less has a smaller x
        total += sign * int(np.dot(w[order], earlier_and_less(key[order], w[order])))
    return total


def _local(cells: DataFrame, x: str, y: str, within: str, *keys: str) -> DataFrame:
    """(keys..., s): `order_sum` of (x, y) inside each group of ``within``."""
    names = list(keys)
    schema = ", ".join([*(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in names), "s decimal(38,0)"])

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        s = order_sum(batch["_x"].to_numpy(), batch["_y"].to_numpy(), batch["w"].to_numpy())
        return pd.DataFrame({**{k: [batch[k].iloc[0]] for k in names}, "s": [Decimal(s)]})

    rows = cells.select(*names, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col("w").cast("long").alias("w"), F.col(within).alias("_in"))
    return rows.groupBy(*names, "_in").applyInPandas(run, schema)


def kendall(cells: DataFrame, *keys: str, ranges: int | None = None) -> DataFrame:
    """(keys..., kendall): tau-b of ``cells`` (keys..., pred, gold, w), null where a side is constant."""
    if not keys:
        return kendall(cells.withColumn("_all", F.lit(0)), "_all", ranges=ranges).drop("_all")
    if ranges is None:
        ranges = min(MOST_RANGES, max(8, cells.count() // RANGE_ROWS))
    bounds = cuts(cells, "pred", ranges, *keys).join(cuts(cells, "gold", ranges, *keys), list(keys))
    bounds = stored(bounds, "cuts")  # a row a group
    columns = ("pred", "gold")
    if bounds.count() * ranges <= BROADCAST_VALUES and all(cells.schema[c].dataType.simpleString() == "double" for c in columns):
        own = bounds.collect()
        known = [{c: np.array([v for v in r[f"{c}_cuts"] or [] if v is not None]) for c in columns} for r in own]
        numbers = cells.sparkSession.createDataFrame([(*(r[k] for k in keys), g) for g, r in enumerate(own)], StructType([*bounds.select(*keys).schema, StructField("_group", IntegerType())]))
        placed = cells.join(F.broadcast(numbers), list(keys)).withColumn("_at", ranges_of({c: F.col(c) for c in columns}, F.col("_group"), known))
        placed = placed.withColumns({f"_{c}": F.col("_at")[c] for c in columns})
    else:
        placed = cells.join(bounds, list(keys))
        for c in columns:
            placed = placed.withColumn(f"_{c}", range_of(F.col(c), F.col(f"{c}_cuts"), ranges))
    placed = stored(placed.select(*keys, "pred", "gold", "w", "_pred", "_gold"), "ranges")
    coarse = placed.groupBy(*keys, F.col("_pred").alias("pred"), F.col("_gold").alias("gold")).agg(F.sum("w").cast("double").alias("w"))
    between = evaluate.order_sum(coarse, *keys).select(*keys, F.col("s").cast("decimal(38,0)").alias("s"))
    same_pred = _local(placed.filter("_pred % 2 = 0"), "pred", "gold", "_pred", *keys)
    same_gold = _local(placed.filter("_gold % 2 = 0"), "_pred", "gold", "_gold", *keys)
    s = between.unionByName(same_pred).unionByName(same_gold).groupBy(*keys).agg(F.sum("s").cast("double").alias("s"))
    ties = [evaluate.untied(cells, c, name, *keys) for c, name in (("pred", "p"), ("gold", "g"))]
    return evaluate.tau(s.join(ties[0], list(keys)).join(ties[1], list(keys)), *keys)


def _new(values: np.ndarray) -> np.ndarray:
    """Whether each of some sorted values is another than the one before; NaN equals NaN."""
    before, now = values[:-1], values[1:]
    return np.r_[np.ones(min(1, len(values)), bool), (now != before) & ~(np.isnan(now) & np.isnan(before))]


class _Passed:
    """Sums over the rows of one group that came by in order of pred, a column for each gold label."""

    def __init__(self, values: int):
        self.w, self.s = np.zeros(values, np.int64), np.zeros(values, np.int64)
        self.rank, self.square, self.tied = np.zeros(values), np.zeros(values), np.zeros(values)

    def add(self, run: np.ndarray, gold: np.ndarray, w: np.ndarray) -> None:
        """Rows of some values of pred, numbered by ``run`` from 0; no later row has one of these."""
        values, runs = len(self.w), int(run[-1]) + 1
        m = np.bincount(run * values + gold, w, runs * values).astype(np.int64).reshape(runs, values)
        under = self.w + np.cumsum(m, axis=0) - m
        tied, before = m.sum(axis=1), under.sum(axis=1)
        less = np.cumsum(under, axis=1) - under
        rank = before + (tied + 1) / 2
        self.s += (m * (less - (before[:, None] - less - under))).sum(axis=0)
        self.rank += rank @ m
        self.square += (rank * rank) @ m
        self.tied += tied.astype(np.float64) @ m
        self.w += m.sum(axis=0)


def _passes(rows: DataFrame, values: list[int]) -> DataFrame:
    """(group, part, gold, w, s, rank, square, tied) of ``rows`` (group, pred, gold, w) sorted by range of pred, whatever the group;
    ranks count from the partition's first row of a group. ``values``: the number of gold labels, which are numbered from 0, of every group.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        kept, size = [], 0
        for b in batches:
            kept.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size >= CHUNK:
                yield [np.concatenate(x) for x in zip(*kept, strict=True)]
                kept, size = [], 0
        if size:
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: dict[int, _Passed] = {}

        def take(group: np.ndarray, pred: np.ndarray, gold: np.ndarray, w: np.ndarray) -> None:
            order = np.argsort(group, kind="stable")
            ends = np.cumsum(np.bincount(group, minlength=len(values)))
            for g in np.unique(group).tolist():
                own = order[ends[g - 1] if g else 0 : ends[g]]
                passed.setdefault(g, _Passed(values[g])).add(np.cumsum(_new(pred[own])) - 1, gold[own], w[own])

        held = None  # rows of the last value so far, one for each group and gold label
        for chunk in chunks(batches):
            group, pred, gold, w = chunk if held is None else (np.concatenate(x) for x in zip(held, chunk, strict=True))
            last = int(np.flatnonzero(_new(pred))[-1])
            take(group[:last], pred[:last], gold[:last], w[:last])
            cell, at = np.unique(group[last:].astype(np.int64) * GOLD_VALUES + gold[last:], return_inverse=True)
            held = [(cell // GOLD_VALUES).astype(np.int32), np.full(len(cell), pred[last]), (cell % GOLD_VALUES).astype(np.int32), np.bincount(at, w[last:]).astype(np.int64)]
        if held is not None:
            take(*held)
        part = TaskContext.get().partitionId()
        for g, p in passed.items():
            n = len(p.w)
            columns = [pa.array(np.repeat(x, n), pa.int32()) for x in (g, part)] + [pa.array(np.arange(n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (p.w, p.s, p.rank, p.square, p.tied))], ["group", "part", "gold", "w", "s", "rank", "square", "tied"])

    return rows.mapInArrow(run, "group int, part int, gold int, w long, s long, rank double, square double, tied double")


def correlations(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, spearman, kendall) of ``cells`` (keys..., pred, gold, w), whose rows may repeat and are read several times; w is a whole number.

    With few gold labels a group, rows are sorted once by range and passed once: a rank is what lies before, and the
    pairs that a row makes with earlier ones are told by how many of those have each gold label.  What is
    left is a row for each partition, group and gold label.  Rows without a value on either side count in neither.
    """
    if not keys:
        return correlations(cells.withColumn("_all", F.lit(0)), "_all").drop("_all")
    names = list(keys)
    cells = cells.filter("pred is not null and gold is not null")
    golds = stored(cells.groupBy(*names, "gold").agg(F.sum("w").alias("w")), "golds")
    sizes = golds.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) > GOLD_VALUES or (sizes[1] or 0) > ALL_GOLD_VALUES or cells.schema["pred"].dataType.simpleString() != "double":
        once = stored(cells.groupBy(*names, "pred", "gold").agg(F.sum("w").alias("w")), "cells")
        return spearman(once, *keys).join(kendall(once, *keys), names)
    place = Window.partitionBy(*names).orderBy("gold")
    ranked = evaluate.ranks(golds, "gold", *keys).select(*names, "gold", "n", F.col("rank").alias("y"), (F.row_number().over(place) - 1).alias("_gold"))
    number = ranked.select(*names).distinct().withColumn("_group", F.row_number().over(Window.orderBy(*names)) - 1)  # a row a group
    known = stored(ranked.join(number, names), "gold-ranks")
    values = [r["n"] for r in known.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).orderBy("_group").collect()]
    coded = cells.join(F.broadcast(known.select(*names, "gold", "_group", "_gold")), [*names, "gold"])
    coded = coded.select(F.col("_group").alias("group"), "pred", F.col("_gold").alias("gold"), F.col("w").cast("long").alias("w"))
    dealt = coded.repartitionByRange("pred").sortWithinPartitions("pred")  # one number, which Spark sorts by its digits
    passed = stored(_passes(dealt, values), "passed")
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = passed.groupBy("group", "part").agg(F.sum("w").alias("_n")).select("group", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("double").alias("before"))
    named = known.select(*names, "y", F.col("_group").alias("group"), F.col("_gold").alias("gold"))
    rows = passed.join(shifts, ["group", "part"]).join(named, ["group", "gold"])
    x = F.col("before") * F.col("w") + F.col("rank")  # the sum of ranks, and of their squares
    xx = F.col("before") * F.col("before") * F.col("w") + 2 * F.col("before") * F.col("rank") + F.col("square")
    y, total = F.col("y"), lambda c: F.sum(c).cast("double")
    sums = rows.groupBy(*names).agg(
        total("w").alias("n"), total(x).alias("sx"), total(y * F.col("w")).alias("sy"), total(x * y).alias("sxy"), total(xx).alias("sxx"), total(y * y * F.col("w")).alias("syy"),
        F.sum(F.col("s").cast("decimal(38,0)")).alias("inside"), total("tied").alias("tied"),
    )
    sums = stored(sums, "sums")
    coarse = rows.filter("w > 0").select(*names, F.col("part").alias("pred"), "gold", F.col("w").cast("double").alias("w"))
    s = evaluate.order_sum(coarse, *keys).withColumnRenamed("s", "between").join(sums, names)
    s = s.select(*names, (F.col("between") + F.col("inside").cast("double")).alias("s"), ((F.col("n") * F.col("n") - F.col("tied")) / 2).alias("p"))
    return evaluate.rho(sums, *keys).join(evaluate.tau(s.join(evaluate.untied(golds, "gold", "g", *keys), names), *keys), names)
