"""Resampling with a hash for a random source, so that every engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluate


#: Largest mean whose draws are inverted term by term.
POISSON_EXACT = 30.0


def poisson1(u: Column) -> Column:
    """Poisson(1) by inversion of u in [0, 1)."""
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return sum((F.when(u >= c, 1).otherwise(0) for c in cuts[1:]), F.when(u >= cuts[0], 1).otherwise(0))


def uniform(*parts: Column) -> Column:
    return T.hash8(*parts).cast("double") / 4294967296.0


def poisson(mean: Column, *key: Column) -> Column:
    """A Poisson draw of the given mean (0 or more), the same for the same ``key``.

    The sum of c draws of mean 1 is one draw of mean c, so a cell of c tokens
    needs one number, not c.  Up to POISSON_EXACT it is the inversion of a uniform
    number, term by term; beyond, a normal one by Box and Muller, corrected
    for skewness.
    """
    # terms of the distribution: e^-c, then each times c / k
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"))
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))

    def step(u: Column, s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.when(u >= s["upto"], F.struct(k.alias("k"), p.alias("p"), (s["upto"] + p).alias("upto"))).otherwise(s)

    walk = lambda u: F.reduce(steps, start, lambda s, k: step(u, s, k), lambda s: s["k"].cast("double"))
    exact = T.let(uniform(*key, F.lit("u")), walk)
    z = F.sqrt(-2.0 * F.log(uniform(*key, F.lit("r")) + 1.1641532182693481e-10)) * F.cos(6.283185307179586 * uniform(*key, F.lit("a")))
    large = F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + 0.5).cast("double"))
    return F.when(mean <= POISSON_EXACT, exact).otherwise(large)


def token_interval(scored: DataFrame, replicates: int = 2000) -> DataFrame:
    """(lang, lo, hi): 2.5 and 97.5 percentiles of Spearman over token bootstraps, by Poisson weights.

    Tokens are counted once, by (prediction, gold); a replicate draws a weight for
    each such cell, so the work after the count does not depend on the tokens.
    Rows are scored tokens, or cells with a weight ``w``.
    """
    cells = evaluate.table(scored, "lang", weight=F.col("w") if "w" in scored.columns else None)
    drawn = cells.select("lang", "pred", "gold", "w", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).repartition("rep")
    millionths = lambda c: F.round(F.col(c) * 1e6).cast("long").cast("string")
    w = poisson(F.col("w"), F.col("rep").cast("string"), F.col("lang"), millionths("pred"), millionths("gold"))
    rho = evaluate.spearman(drawn.withColumn("w", w).filter("w > 0"), "lang", "rep")
    return rho.groupBy("lang").agg(F.percentile("spearman", F.lit(0.025)).alias("lo"), F.percentile("spearman", F.lit(0.975)).alias("hi"))


def paired_difference(first: DataFrame, second: DataFrame, replicates: int = 50) -> DataFrame:
    """Document bootstrap of the macro difference between two systems on the same documents.

    Documents are drawn once for both systems, a number a document and replicate;
    each document enters as its own contingency times its weight.  Rows are scored
    tokens, or cells with a weight ``w``.
    """
    def cells(scored: DataFrame, name: str) -> DataFrame:
        counted = evaluate.table(scored, "lang", "pair_id", weight=F.col("w") if "w" in scored.columns else None)
        return counted.withColumn("system", F.lit(name))

    both = cells(first, "one").unionByName(cells(second, "two"))
    own = both.groupBy("pair_id").agg(F.collect_list(F.struct("system", "lang", "pred", "gold", "w")).alias("cells"))
    draw = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda k: poisson1(uniform(k.cast("string"), F.col("pair_id").cast("string")))))
    reps = own.select("cells", draw.alias("rep", "times")).filter("times > 0").select("rep", "times", F.inline("cells"))
    drawn = reps.groupBy("system", "lang", "rep", "pred", "gold").agg(F.sum(F.col("w") * F.col("times")).alias("w"))
    macros = evaluate.spearman(drawn, "system", "lang", "rep").groupBy("rep", "system").agg(F.avg("spearman").alias("macro"))
    of = lambda name: F.max(F.when(F.col("system") == name, F.col("macro")))
    d = macros.groupBy("rep").agg((of("one") - of("two")).alias("d"), F.count_distinct("system").alias("n")).filter("n = 2")
    return d.agg(
        F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"),
        F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p_not_above"),
    ).withColumn("includes_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))


def best_config(per_config: DataFrame) -> DataFrame:
    """The row of highest macro; the first in grid order on ties."""
    return per_config.filter("macro is not null").orderBy(F.col("macro").desc(), "grid_idx").limit(1)

