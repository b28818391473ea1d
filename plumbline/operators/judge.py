"""Judgment of aligned segments by the deterministic lexical backend, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .stored import met


def _joined(ops: DataFrame, segments: DataFrame, side: str) -> DataFrame:
    """(pair_id, op_idx, text_x, tok_lo_x, tok_hi_x, char_lo_x): an operation's segments of a side, joined by a space."""
    spans = ops.filter(f"{side}_start >= 0").select("pair_id", "op_idx", F.explode(F.sequence(f"{side}_start", F.col(f"{side}_end") - 1)).alias("seg"))
    s = segments.filter(F.col("side") == side).select("pair_id", "seg", "tok_lo", "tok_hi", "char_lo", "text")
    parts = F.sort_array(F.collect_list(F.struct("seg", "text")))
    return (
        met(spans, s, ["pair_id", "seg"])
        .groupBy("pair_id", "op_idx")
        .agg(
            F.array_join(parts.getField("text"), " ").alias(f"text_{side}"), F.min("tok_lo").alias(f"tok_lo_{side}"),
            F.max("tok_hi").alias(f"tok_hi_{side}"), F.min("char_lo").alias(f"char_lo_{side}"),
        )
    )


def differing_span(words: Column, low: Column, other_low: Column) -> Column:
    """The first three of ``words`` whose lower form ``low`` is not in ``other_low``, joined by a space; null without any."""
    own = T.let(other_low, lambda seen: F.slice(F.filter(F.arrays_zip(words.alias("w"), low.alias("l")), lambda t: ~F.array_contains(seen, t["l"])), 1, 3))
    return T.let(own, lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda t: t["w"]), " ")))


def passages(ops: DataFrame, segments: DataFrame) -> DataFrame:
    """Two-sided operations with the texts of both sides and where they stand."""
    two = ops.filter("a_start >= 0 and b_start >= 0")
    on = ["pair_id", "op_idx"]
    return met(met(two, _joined(two, segments, "a"), on), _joined(two, segments, "b"), on)


def judgments(ops: DataFrame, segments: DataFrame, seed: int = 0) -> DataFrame:
    """Two-sided operations with difference (0 to 5) and the differing spans that occur verbatim."""
    j = passages(ops, segments)
    a, b = F.col("text_a"), F.col("text_b")
    words = lambda text: F.array_distinct(T.norm_tokens(text))
    sim = T.let(words(a), lambda x: T.let(words(b), lambda y: T.lexical_similarity(x, y)))  # each text's words once, not once a word
    level = F.rint(5 * (1.0 - sim) + T.noise(a, b, seed) * 3)
    j = j.withColumn("difference", F.greatest(F.lit(0.0), F.least(F.lit(5.0), level)).cast("int"))
    lower = lambda words: F.transform(words, F.lower)

    def verbatim(own: str, other: str) -> Column:
        span = T.let(T.split_words(F.col(own)), lambda w: differing_span(w, lower(w), F.array_distinct(lower(T.split_words(F.col(other))))))
        return F.when(F.col("difference") >= 2, T.let(span, lambda x: F.when(F.contains(F.col(own), x), x)))

    return j.withColumns({"span_a": verbatim("text_a", "text_b"), "span_b": verbatim("text_b", "text_a")})
