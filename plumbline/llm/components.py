"""Connected components of an edge table, by large-star and small-star rounds.

Every round is a few grouped minima and equality joins; nothing is gathered on
the driver but one count and one checksum a round.  A node with very many
neighbours is spread by the skew handling of the joins, whose two sides are
written tables.  The number of rounds grows with the logarithm of the longest
shortest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b; longs) with the smallest node it reaches.

    Nodes without an edge to another node are absent.
    """
    now = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components-edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-low")
        # large star: neighbours above a node go to the smallest of its neighbourhood
        large = store(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "components-large")
        low = store(large.groupBy("a").agg(F.min("b").alias("m")), "components-low")
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = store(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components-edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
