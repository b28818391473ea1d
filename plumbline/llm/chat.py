"""Chat formatting: cumulative snapshots collapsed before rendering (native DataFrame functions only).

A log often holds a conversation again and again, each time with more turns.
Each turn's rolling prefix hash stands for the conversation up to it: the XOR of
one 128-bit hash of (position, role, text) per turn, which can be summed in
parts.  A conversation goes if its full hash is a proper prefix hash of another
(anti-join), or if an equal one has a smaller conv_id.  The rest are rendered.

Turns are numbered and hashed in parts of PART turn numbers, so a conversation
that holds a third of all rows is spread over many tasks; the parts' counts and
hashes are summed over one row a part.  Rendered text comes in the same parts.

Defined cases: order is (turn, role, text), nulls first; null turns form a part
of their own at the start.  Null role or text differs from the empty string in
the hashes and renders as empty.  Null conv_id is one conversation.  Repeated rows are turns of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

PART = 1024
START, END = "<|im_start|>", "<|im_end|>"


def _hashes(rank: Column) -> list[Column]:
    told = [rank, F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return [F.xxhash64(F.lit(seed), *told).alias(f"h{seed}") for seed in (1, 2)]


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, part, turn, role, text) with rank, n_turns, and prefix hashes p1, p2."""
    part = F.coalesce(F.floor(F.col("turn") / PART), F.lit(-(1 << 50))).cast("long")
    t = turns.select("conv_id", "turn", "role", "text", part.alias("part"))
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("at", F.row_number().over(inside))
    sizes = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(whole).alias("n_turns"))
    t = _join(t, sizes, "conv_id", "part").withColumn("rank", F.col("skip") + F.col("at"))
    t = t.select("conv_id", "part", "turn", "role", "text", "rank", "n_turns", *_hashes(F.col("rank")))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    t = t.withColumns({f"x{k}": F.bit_xor(f"h{k}").over(upto) for k in (1, 2)})
    t = _join(t, sums, "conv_id", "part")
    return t.select("conv_id", "part", "turn", "role", "text", "rank", "n_turns", *[F.col(f"b{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)])


def _join(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of ``a`` stay."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*[f"_{k}" for k in keys])


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the maximal conversations, from numbered turns."""
    full = turns.filter(F.col("rank") == F.col("n_turns"))
    unique = full.groupBy("p1", "p2", "rank").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = turns.filter(F.col("rank") < F.col("n_turns")).select("p1", "p2", "rank").distinct()
    return unique.join(proper, ["p1", "p2", "rank"], "left_anti").select("conv_id", "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text, a row for each part: conv_id, part, n_turns, n_copies, rendered."""
    t = store(numbered(turns), "chat-turns")
    best = store(collapse(t), "chat-maximal")
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    one = _join(t.select("conv_id", "part", "rank", "n_turns", piece.alias("piece")), best, "conv_id")
    parts = one.groupBy("conv_id", "part").agg(
        F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("p")
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("p.piece"), "").alias("rendered"))
