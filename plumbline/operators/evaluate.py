"""Predicted against gold labels: joins on id, padding, rank correlations, macros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def missing(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold ids without a prediction; counted before any ids are dropped."""
    return gold.join(predictions.select("pair_id"), "pair_id", "left_anti").select("pair_id", "lang")


def aligned(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """(pair_id, lang, side, k, pred, gold): predictions cut or padded with 0 to the gold's length.

    Side B counts only where some gold label of it is not -1.
    """
    p = predictions.select("pair_id", F.col("labels_a").alias("pa"), F.col("labels_b").alias("pb"))
    return exploded(gold.join(p, "pair_id"))


def exploded(joined: DataFrame) -> DataFrame:
    """`aligned` of rows that hold gold labels (labels_a, labels_b) and predictions (pa, pb) already."""
    return joined.select("pair_id", "lang", F.explode(zipped()).alias("x")).select("pair_id", "lang", "x.*")


def b_counts() -> Column:
    """Whether a gold label of side B is not -1."""
    return ~F.forall("labels_b", lambda v: v == -1.0)


def zipped() -> Column:
    """Array of (side, k, pred, gold) of a row with labels_a, labels_b (gold) and pa, pb (predicted), as `aligned` explodes it."""
    padded = lambda g, p: F.transform(g, lambda v, k: F.struct(k.alias("k"), F.coalesce(F.get(p, k), F.lit(0.0)).alias("pred"), v.alias("gold")))
    side = lambda s, zipped: F.transform(zipped, lambda x: F.struct(F.lit(s).alias("side"), x["k"].alias("k"), x["pred"].alias("pred"), x["gold"].alias("gold")))
    b = F.when(b_counts(), F.col("labels_b")).otherwise(F.slice("labels_b", 1, 0))
    return F.concat(side("a", padded(F.col("labels_a"), "pa")), side("b", padded(b, "pb")))


def compared() -> Column:
    """Array of (pred, gold) of a row as `zipped` takes it with ``b``, whether side B counts; a prediction that is not there is 0, or null if given so.

    Whole arrays are cut and joined, so nothing is done label by label.
    """
    fit = lambda p, g: F.concat(F.slice(p, 1, F.size(g)), F.array_repeat(F.lit(0.0), F.greatest(F.size(g) - F.size(p), F.lit(0))))
    side = lambda p, g: F.arrays_zip(fit(F.coalesce(p, F.array().cast("array<double>")), g).alias("pred"), F.col(g).alias("gold"))
    return F.when(F.col("b"), F.concat(side("pa", "labels_a"), side("pb", "labels_b"))).otherwise(side("pa", "labels_a"))


def length_mismatches(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    p = predictions.select("pair_id", F.size("labels_a").alias("p_a"), F.size("labels_b").alias("p_b"))
    return mismatches(gold.join(p, "pair_id").select("lang", *[F.size(f"labels_{s}").alias(f"n_{s}") for s in "ab"], "p_a", "p_b", b_counts().alias("b_counts")))


def mismatches(sizes: DataFrame) -> DataFrame:
    """`length_mismatches` from how many labels each side of a pair has: (lang, n_a, n_b) in gold, (p_a, p_b) predicted, and whether side B counts."""
    return sizes.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("n_a") != F.col("p_a")).alias("len_mismatch_a"),
        F.count_if(F.col("b_counts") & (F.col("n_b") != F.col("p_b"))).alias("len_mismatch_b"),
    )


def table(scored: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """Contingency (keys..., pred, gold, w) of scored tokens: few rows however many tokens."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return scored.filter("gold <> -1").groupBy(*keys, "pred", "gold").agg(w.cast("double").alias("w"))


def ranks(contingency: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys..., column, n, rank): average ranks from cumulative counts over distinct values."""
    values = contingency.groupBy(*keys, column).agg(F.sum("w").alias("n"))
    before = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0.0)) + (F.col("n") + 1) / 2)


def spearman(contingency: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, spearman): Pearson correlation of average ranks; null where constant or under two tokens."""
    rp = ranks(contingency, "pred", *keys).select(*keys, "pred", F.col("rank").alias("x"))
    rg = ranks(contingency, "gold", *keys).select(*keys, "gold", F.col("rank").alias("y"))
    j = contingency.join(rp, [*keys, "pred"]).join(rg, [*keys, "gold"])
    return pearson(j, F.col("x"), F.col("y"), *keys)


def pearson(rows: DataFrame, x: Column, y: Column, *keys: str) -> DataFrame:
    """(keys..., n, spearman): correlation of ``x`` and ``y`` over rows of weight w; null where constant or under two rows."""
    s = lambda e: F.sum(F.col("w") * e)
    return rho(rows.groupBy(*keys).agg(F.sum("w").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * y).alias("sxy"), s(x * x).alias("sxx"), s(y * y).alias("syy")), *keys)


def rho(sums: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, spearman) from n and the sums sx, sy, sxy, sxx and syy; null where constant or under two rows."""
    n, vx, vy = F.col("n"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    found = F.when((n >= 2) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.greatest(vx, F.lit(1e-300))) / F.sqrt(F.greatest(vy, F.lit(1e-300))))
    return sums.select(*keys, n.cast("long").alias("n"), found.alias("spearman"))


def kendall(contingency: DataFrame, *keys: str) -> DataFrame:
    """(keys..., kendall): tau-b from running sums over contingency cells, never from pairs of tokens or cells.

    The work is distinct predictions times distinct gold labels, of which there
    are few.  Null where a side is constant.
    """
    if not keys:
        return kendall(contingency.withColumn("_all", F.lit(0)), "_all").drop("_all")
    ties = [untied(contingency, c, name, *keys) for c, name in (("pred", "p"), ("gold", "g"))]
    return tau(order_sum(contingency, *keys).join(ties[0], list(keys)).join(ties[1], list(keys)), *keys)


def order_sum(contingency: DataFrame, *keys: str) -> DataFrame:
    """(keys..., s): over pairs of cells the product of their weights, positive where predictions and gold labels order them alike, else negative."""
    keys_ = list(keys)
    preds, golds = (contingency.select(*keys_, x).distinct() for x in ("pred", "gold"))
    cells = preds.join(golds, keys_).join(contingency, [*keys_, "pred", "gold"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    by_pred, by_gold = Window.partitionBy(*keys_, "gold").orderBy("pred"), Window.partitionBy(*keys_, "pred").orderBy("gold")
    lower = cells.withColumn("under", F.coalesce(F.sum("w").over(by_pred.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    part = lambda lo, hi: F.coalesce(F.sum("under").over(by_gold.rowsBetween(lo, hi)), F.lit(0.0))
    signed = lower.select(*keys_, (F.col("w") * (part(Window.unboundedPreceding, -1) - part(1, Window.unboundedFollowing))).alias("s"))
    return signed.groupBy(*keys_).agg(F.sum("s").alias("s"))


def untied(cells: DataFrame, column: str, name: str, *keys: str) -> DataFrame:
    """(keys..., name): pairs of rows that differ in ``column``."""
    t = cells.groupBy(*keys, column).agg(F.sum("w").cast("double").alias("t"))
    return t.groupBy(*keys).agg(((F.sum("t") * F.sum("t") - F.sum(F.col("t") * F.col("t"))) / 2).alias(name))


def tau(sums: DataFrame, *keys: str) -> DataFrame:
    """(keys..., kendall) from s, and the untied pairs p and g of either side; null where a side is constant."""
    found = F.when((F.col("p") > 0) & (F.col("g") > 0), F.col("s") / F.sqrt(F.greatest(F.col("p"), F.lit(1e-300))) / F.sqrt(F.greatest(F.col("g"), F.lit(1e-300))))
    return sums.select(*keys, found.alias("kendall"))


def strict_macro(per_lang: DataFrame, required: int, value: str = "spearman") -> DataFrame:
    """Mean over languages, null unless all ``required`` have a value; and the mean over those that have one."""
    v = F.col(value)
    return per_lang.agg(
        F.when(F.count(v) == required, F.avg(v)).alias("strict_macro"), F.avg(v).alias("descriptive_macro"), F.count(v).alias("n_defined")
    )
