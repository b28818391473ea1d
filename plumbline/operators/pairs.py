"""Pair views over the driver's tables: two texts side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import stored


def ranked(rows: DataFrame, groups: list[str], order: str) -> DataFrame:
    """``rows`` with r, the place from 1 of a row in its group, in the order of ``order``.

    Rows are sorted by range, so a group of any size is spread over tasks: a
    row's place is its place in its partition and what earlier partitions hold of
    the group.  Only those counts, a row a partition and group in it, meet in a window.
    """
    dealt = rows.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    at = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranked")
    runs = at.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return at.join(runs, [*groups, "_part"]).withColumn("r", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, lang, id_b): the r-th English document of a source with its r-th other one, without texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.filter("lang is not null and source is not null").select("doc_id", "lang", "source", (F.col("lang") == "en").alias("english"))
    r = ranked(some, ["source", "english"], "doc_id")
    a = r.filter("english").select("source", "r", F.col("doc_id").alias("pair_id"))
    b = r.filter("not english").select("source", "r", "lang", F.col("doc_id").alias("id_b"))
    return a.join(b, ["source", "r"]).select("pair_id", "lang", "id_b")


def pair_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, lang, text_a, text_b): `pair_ids` with texts.

    Only ids are ranked; texts are joined afterwards, pair_id last: rows are then spread
    by pair, and what works on a pair's tokens or segments needs no shuffle.
    """
    ids = pair_ids(spark, sf_dir)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return (
        ids.join(text.select(F.col("doc_id").alias("id_b"), F.col("text").alias("text_b")), "id_b")
        .join(text.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("text_a")), "pair_id")
        .select("pair_id", "lang", "text_a", "text_b")
    )


def pair_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, lang, text_a, text_b): a user turn with the assistant turn after it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    a = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("text_a"))
    b = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"))
    pair = F.concat_ws("-", "conv_id", "turn")
    return a.join(b, ["conv_id", "turn"]).select(pair.alias("pair_id"), F.lit("xx").alias("lang"), "text_a", "text_b")


def sides(pairs: DataFrame) -> DataFrame:
    """(pair_id, lang, side, text): a row for each text of a pair.

    Texts are dealt by pair here, unless they are already: their tokens, many
    times as many rows, then need no shuffle for what is asked of a pair or a text.
    """
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"text_{s}").alias("text")) for s in "ab"])).alias("s")
    return pairs.repartition("pair_id").select("pair_id", "lang", one).select("pair_id", "lang", "s.side", "s.text")
