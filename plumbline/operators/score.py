"""Token labels from operations and judgments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .stored import met


@dataclass(frozen=True)
class ScoreConfig:
    diff_a: float = 1.0
    diff_b: float = 0.0
    span_boost: float = 0.25
    span_floor: float = 0.6
    omit_label: float = 0.9
    add_label: float = 0.9
    fallback_scale: float = 1.0
    boilerplate_cap: float = 1.0


def _spans(judged: DataFrame, side: str) -> Column:
    """The differing spans of a side: column spans_x (several), or span_x (one, or null)."""
    return F.col(f"spans_{side}") if f"spans_{side}" in judged.columns else F.array(f"span_{side}")


def span_places(judged: DataFrame, sides: DataFrame) -> DataFrame:
    """(pair_id, op_idx, side, span, pos, tok_lo, tok_hi, lo, hi): where each span first occurs at or after its operation's
    first segment, else anywhere in the text, and the tokens lo..hi - 1 that it overlaps; pos is null where it does not occur.

    A text meets all its spans in one row.  Tokens are counted from the segment's
    first one to the span, so no token is a row and no offsets are needed.
    """
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _spans(judged, s).alias("spans"), F.col(f"tok_lo_{s}").alias("tok_lo"), F.col(f"tok_hi_{s}").alias("tok_hi"), F.col(f"char_lo_{s}").alias("char_lo")) for s in "ab"]))
    spans = judged.select("pair_id", "op_idx", one.alias("s")).select("pair_id", "op_idx", "s.*").withColumn("span", F.explode("spans")).filter("span is not null")
    of_text = spans.groupBy("pair_id", "side").agg(F.collect_list(F.struct("op_idx", "span", "tok_lo", "tok_hi", "char_lo")).alias("spans"))
    count = lambda text: F.size(T.split_words(text))

    def place(s: Column) -> Column:
        text, n = F.col("text"), F.length(s["span"])

        def tokens(pos: Column) -> Column:
            here = pos >= s["char_lo"]
            char, tok = F.when(here, s["char_lo"]).otherwise(0), F.when(here, s["tok_lo"]).otherwise(0)
            before = F.substring(text, char + 1, pos - char)
            inside = before.rlike(f"[^{T.WS}]\\z") & F.substring(text, pos + 1, F.lit(1)).rlike(T.WORD)
            lo, hi = tok + count(before) - inside.cast("int"), tok + count(F.substring(text, char + 1, pos - char + n))
            named = [s[c].alias(c) for c in ("op_idx", "span", "tok_lo", "tok_hi")]
            return F.struct(*named, pos.alias("pos"), F.when(pos.isNotNull(), lo).alias("lo"), F.when(pos.isNotNull(), hi).alias("hi"))

        first = F.coalesce(F.nullif(T.locate(s["span"], text, s["char_lo"] + 1), F.lit(0)), F.nullif(T.locate(s["span"], text, F.lit(1)), F.lit(0))) - 1
        return T.let(first, tokens)

    found = met(of_text, sides.select("pair_id", "side", "text"), ["pair_id", "side"]).select("pair_id", "side", F.inline(F.transform("spans", place)))
    return found.select("pair_id", "op_idx", "side", "span", "pos", "tok_lo", "tok_hi", "lo", "hi")


def span_tokens(places: DataFrame) -> DataFrame:
    """The rows of placed spans that hold a token, once for each (idx)."""
    return places.filter("lo < hi").withColumn("idx", F.explode(F.expr("sequence(lo, hi - 1)"))).drop("lo", "hi")


def _by_segment(levels: DataFrame) -> DataFrame:
    """(pair_id, side, seg, m): the operation that covers a segment, with its level and its spans. Operations of a side do not overlap."""
    own = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end"), F.col(f"ranges_{s}").alias("ranges"))
    rows = levels.select("pair_id", "op", "level", F.explode(F.array(own("a"), own("b"))).alias("s")).filter("s.start >= 0")
    return rows.select("pair_id", "s.side", F.explode(F.expr("sequence(s.start, s.end - 1)")).alias("seg"), F.struct("op", "level", "s.ranges").alias("m"))


def token_levels(tokens: DataFrame, ops: DataFrame, judged: DataFrame, sides: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(pair_id, lang, side, idx, tok, op, level, boost): all that a token's label is made of, whatever the labels of omissions, additions and spans.

    ``tokens`` may be segments: a segment then meets its operation, and its tokens are
    cut afterwards, so no token is moved, and none carries what belongs to other segments.
    """
    # least and greatest pass over nulls, so a missing value is asked for first
    base = F.when(F.col("difference").isNotNull(), T.clamp01(cfg.diff_a * (F.col("difference") / 5.0) + cfg.diff_b))
    fallback = F.least(F.lit(1.0), (1.0 - F.col("sim")) * cfg.fallback_scale)
    part = F.struct(F.greatest("lo", "tok_lo").alias("lo"), F.least("hi", "tok_hi").alias("hi"))
    ranges = lambda s: F.collect_list(F.when(F.col("side") == s, part)).alias(f"ranges_{s}")
    boosted = span_places(judged, sides).filter("lo < hi").groupBy("pair_id", "op_idx").agg(ranges("a"), ranges("b"))
    on = ["pair_id", "op_idx"]
    levels = met(met(ops, judged.select(*on, "difference"), on, "left"), boosted, on, "left")
    levels = levels.withColumn("level", F.coalesce(base, fallback))
    t = met(tokens, _by_segment(levels), ["pair_id", "side", "seg"], "left")
    if "tok" not in tokens.columns:
        t = t.select("pair_id", "lang", "side", "tok_lo", "m", F.posexplode(T.split_words(F.col("text"))).alias("k", "tok")).withColumn("idx", F.col("tok_lo") + F.col("k"))
    boost = F.exists("m.ranges", lambda r: (F.col("idx") >= r["lo"]) & (F.col("idx") < r["hi"]))
    return t.select("pair_id", "lang", "side", "idx", "tok", "m.op", "m.level", F.coalesce(boost, F.lit(False)).alias("boost"))


def label(cfg: ScoreConfig = ScoreConfig(), omit: Column | None = None, add: Column | None = None, boost: Column | None = None) -> Column:
    """The label of a row of `token_levels`: -1 for punctuation, else 0 (equivalent) to 1 (different). Columns can stand for three of the settings."""
    omit, add, boost = (F.lit(v) if c is None else c for c, v in ((omit, cfg.omit_label), (add, cfg.add_label), (boost, cfg.span_boost)))
    raised = F.greatest(F.lit(cfg.span_floor), F.least(F.lit(1.0), F.col("level") + boost))
    matched = F.least(F.lit(cfg.boilerplate_cap), F.when(F.col("boost"), raised).otherwise(F.col("level")))
    return F.when(T.is_punctuation(F.col("tok")), -1.0).when(F.col("op") == "1:0", omit).when(F.col("op") == "0:1", add).when(F.col("level").isNull(), 0.0).otherwise(matched)


def token_labels(tokens: DataFrame, ops: DataFrame, judged: DataFrame, sides: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """(pair_id, lang, side, idx, tok, label) of every token."""
    return token_levels(tokens, ops, judged, sides, cfg).select("pair_id", "lang", "side", "idx", "tok", label(cfg).alias("label"))


def label_stats(judged: DataFrame, sides: DataFrame) -> DataFrame:
    """(span_matched, span_unmatched, parse_failures, repairs): how spans and replies fared over all pairs."""
    p = span_places(judged, sides)
    repairs = F.coalesce(F.sum("repairs"), F.lit(0)) if "repairs" in judged.columns else F.lit(0).cast("long")
    fails = judged.agg(F.count_if(F.col("difference").isNull()).alias("parse_failures"), repairs.alias("repairs"))
    return p.agg(F.count_if(F.col("pos").isNotNull()).alias("span_matched"), F.count_if(F.col("pos").isNull()).alias("span_unmatched")).crossJoin(fails)  # a row each


def grid(spark: SparkSession, boosts=(0.0, 0.2, 0.4), omits=(0.7, 0.9, 1.0), adds=(0.7, 0.9, 1.0)) -> DataFrame:
    """(grid_idx, span_boost, omit_label, add_label): the calibration grid, in its order."""
    rows = [(k, *x) for k, x in enumerate((b, o, a) for b in boosts for o in omits for a in adds)]
    return spark.createDataFrame(rows, "grid_idx int, span_boost double, omit_label double, add_label double")
