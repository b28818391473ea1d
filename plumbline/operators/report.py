"""Evaluation as one call, gaps, and comparison with other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate as E
from . import guard
from .stored import stored

# Numbers of the ids that the second evaluation leaves out.
SUFFIXES = (18, 100, 106, 153, 196)

#: Systems that are compared at once.
MOST_SYSTEMS = 1000


class Incomplete(ValueError):
    """Predictions are missing where all were required."""


def drop_ids(spark, languages: tuple[str, ...] = guard.LANGUAGES, suffixes: tuple[int, ...] = SUFFIXES, pattern: str = "admin_{lang}_{n}") -> DataFrame:
    """(pair_id): ids that a second evaluation leaves out, every suffix in every language."""
    return spark.createDataFrame([(pattern.format(lang=x, n=n),) for x in languages for n in suffixes], "pair_id string")


def gaps(gold: DataFrame, predictions: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, n_missing, first_missing, absent) for each language that lacks predictions: the first five ids, and whether it has none at all."""
    have = gold.join(predictions.select("pair_id").distinct().withColumn("_there", F.lit(True)), "pair_id", "left")
    g = have.groupBy("lang").agg(F.count_if(F.col("_there").isNull()).alias("n_missing"), F.count("_there").alias("n_there"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pair_id"))  # five a task and language reach the window
    few = have.filter("_there is null").select("lang", "pair_id", place.alias("k")).filter("k <= 5")
    few = few.groupBy("lang").agg(F.array_sort(F.collect_list("pair_id")).alias("first"))
    wanted = gold.sparkSession.createDataFrame([(x,) for x in languages], "lang string")
    j = wanted.join(g, "lang", "left").join(few, "lang", "left").select(
        "lang", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.concat_ws(",", F.col("first").cast("array<string>")).alias("first_missing"), (F.coalesce("n_there", F.lit(0)) == 0).alias("absent")
    )
    return j.filter("n_missing > 0 or absent")


def invalid_reason(n_samples: Column, n: Column, rho: Column) -> Column:
    """Why a correlation is not there; null where it is."""
    return F.when(rho.isNotNull(), F.lit(None).cast("string")).when(n_samples == 0, "no predictions").when(n < 2, "fewer than two scored tokens").otherwise("constant labels")


def evaluate(predictions: DataFrame, gold: DataFrame, languages: list[str], drop: DataFrame | None = None, require_full: bool = False, items: DataFrame | None = None) -> DataFrame:
    """One row for each variant (all ids; those not in ``drop``) and language with every measure.

    (variant, lang, n_gold_items, n_samples, n_tokens, len_mismatch_a, len_mismatch_b, coverage, missing, spearman, kendall, invalid_reason).
    Missing ids are counted before any are dropped; coverage after.  Labels of
    predictions and gold meet once; all measures of both variants come from what that wrote.
    ``items`` (pair_id, lang) are all gold ids, where ``gold`` has the labels of those with predictions only.
    """
    items = gold if items is None else items
    if require_full and (g := gaps(items, predictions, languages).collect()):
        raise Incomplete("; ".join(f"{r['lang']}: {'none' if r['absent'] else r['n_missing']} missing {r['first_missing']}" for r in g))
    predictions = E.last_wins(predictions, "pair_id", "at") if "at" in predictions.columns else predictions
    p = predictions.select("pair_id", F.col("labels_a").alias("pa"), F.col("labels_b").alias("pb"))
    one, two = F.array(F.lit("all")), F.array(F.lit("all"), F.lit("excluding"))
    out = drop.select("pair_id").distinct().withColumn("_out", F.lit(True)) if drop is not None else None
    tagged = lambda d: d.withColumn("variants", one) if out is None else d.join(out, "pair_id", "left").withColumn("variants", F.when(F.col("_out"), one).otherwise(two))
    asked = tagged(items.select("pair_id", "lang").join(p.select("pair_id", F.lit(True).alias("there")), "pair_id", "left"))
    both = gold.select("pair_id", "lang", "labels_a", "labels_b").join(p, "pair_id")
    both = stored(tagged(both).select("variants", "lang", "labels_a", "labels_b", "pa", "pb", E.b_counts().alias("b")), "evaluated")
    # pairs and tokens are counted with their variants as an array, so each is counted once
    count, n = F.count_if, {c: F.size(c) for c in ("labels_a", "labels_b", "pa", "pb")}
    met = both.groupBy("variants", "lang").agg(
        F.sum(n["labels_a"] + F.when(F.col("b"), n["labels_b"]).otherwise(0)).alias("n_tokens"), count(n["labels_a"] != n["pa"]).alias("len_mismatch_a"), count(F.col("b") & (n["labels_b"] != n["pb"])).alias("len_mismatch_b"),
    )
    asked = asked.groupBy("variants", "lang").agg(F.count(F.lit(1)).alias("n_gold_items"), F.count("there").alias("n_samples"))
    asked = stored(asked.join(met, ["variants", "lang"], "left"), "counted")
    counts = ("n_gold_items", "n_samples", "n_tokens", "len_mismatch_a", "len_mismatch_b")
    pairs = asked.select(F.explode("variants").alias("variant"), "lang", *counts).groupBy("variant", "lang").agg(*[F.sum(c).alias(c) for c in counts])
    missing = asked.groupBy("lang").agg(F.sum(F.col("n_gold_items") - F.col("n_samples")).alias("missing"))
    tokens = both.select("variants", "lang", F.inline(E.compared())).withColumn("pred", F.coalesce("pred", F.lit(0.0)))
    cells = E.table(tokens, "variants", "lang").select(F.explode("variants").alias("variant"), "lang", "pred", "gold", "w")
    cells = stored(cells.groupBy("variant", "lang", "pred", "gold").agg(F.sum("w").alias("w")), "cells")
    names = [(v, x) for v in (("all", "excluding") if drop is not None else ("all",)) for x in languages]
    rows = gold.sparkSession.createDataFrame(names, "variant string, lang string")
    keys = ["variant", "lang"]
    rows = rows.join(pairs, keys, "left").join(E.spearman(cells, *keys), keys, "left").join(E.kendall(cells, *keys), keys, "left").join(missing, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "variant", "lang", zero("n_gold_items"), zero("n_samples"), zero("n_tokens"), zero("len_mismatch_a"), zero("len_mismatch_b"),
        F.round(F.coalesce(F.try_divide("n_samples", "n_gold_items"), F.lit(0.0)), 6).alias("coverage"), zero("missing"), "spearman", "kendall",
        invalid_reason(F.coalesce("n_samples", F.lit(0)), F.coalesce("n", F.lit(0)), F.col("spearman")).alias("invalid_reason"),
    )


def matched(first: DataFrame, second: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, lang, n_matched, spearman): two methods on the ids that both have."""
    labels = ("pair_id", "labels_a", "labels_b")
    first, second, gold = (stored(d.select(*c), "labels") for d, c in ((first, labels), (second, labels), (gold, (*labels, "lang"))))
    both = first.select("pair_id").distinct().join(second.select("pair_id").distinct(), "pair_id")
    parts = []
    for name, p in (("first", first), ("second", second)):
        scored = E.aligned(gold.join(both, "pair_id", "left_semi"), p)
        cells = stored(E.table(scored, "lang"), "cells")
        used = (F.size("labels_a") > 0) | E.b_counts()  # a pair with a token that is compared
        met = gold.join(both, "pair_id", "left_semi").join(p.select("pair_id", F.col("labels_a").alias("pa"), F.col("labels_b").alias("pb")), "pair_id")
        n = met.filter(used).groupBy("lang").agg(F.count_distinct("pair_id").alias("n_matched"))
        parts.append(n.join(E.spearman(cells, "lang"), "lang").select(F.lit(name).alias("method"), "lang", "n_matched", "spearman"))
    return parts[0].unionByName(parts[1])


def matched_list(first: DataFrame, second: DataFrame, gold: DataFrame) -> DataFrame:
    """(lang, pair_id): the ids that both methods have, in order."""
    both = first.select("pair_id").distinct().join(second.select("pair_id").distinct(), "pair_id")
    return gold.select("lang", "pair_id").join(both, "pair_id", "left_semi").select("lang", "pair_id").orderBy("lang", "pair_id")


def compare_systems(systems: DataFrame, gold: DataFrame) -> DataFrame:
    """(system, lang, spearman, kendall, macro): rounded to four places; the macro is the mean of the rounded values, rounded.

    ``systems``: predictions with ``system``.  Every system must have every gold id.
    """
    systems, gold = stored(systems.select("system", "pair_id", "labels_a", "labels_b"), "systems"), stored(gold.select("pair_id", "lang", "labels_a", "labels_b"), "gold")
    names = [r["system"] for r in systems.select("system").distinct().limit(MOST_SYSTEMS + 1).collect()]
    if len(names) > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} systems")
    each = gold.select("pair_id", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).alias("system"))
    absent = each.join(systems, ["system", "pair_id"], "left_anti")
    short = absent.groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.min("pair_id").alias("one")).collect()
    if short:
        raise Incomplete("; ".join(f"{r['system']}: {r['n']} missing, {r['one']} among them" for r in short))
    many = gold.join(systems.select("system", "pair_id", F.col("labels_a").alias("pa"), F.col("labels_b").alias("pb")), "pair_id")
    tag = F.concat_ws("\x1f", "system", "lang")  # labels of a system and a language are pooled together
    scored = E.exploded(many.select("pair_id", tag.alias("lang"), "labels_a", "labels_b", "pa", "pb"))
    cells = stored(E.table(scored, "lang"), "cells")
    r = E.spearman(cells, "lang").join(E.kendall(cells, "lang"), "lang")
    parts = F.split("lang", "\x1f")
    r = r.select(F.get(parts, F.lit(0)).alias("system"), F.get(parts, F.lit(1)).alias("lang"), F.round("spearman", 4).alias("spearman"), F.round("kendall", 4).alias("kendall"))
    macro = r.groupBy("system").agg(F.round(F.avg("spearman"), 4).alias("macro"))
    return r.join(macro, "system")
