"""Quality rules with adaptive thresholds (native DataFrame functions only).

Each document gets counts and integer rates.  Of the documents that pass the
base rule a quantile sketch of every rate is kept per language and source:
values below 128 count exactly, larger ones under their seven leading bits, so a
quantile is low by 1/64 at most.  Sketches are counts by bucket; they merge by
addition, in any order and with the same result, and the sketches of a language,
or of everything, are the sums of their parts.  A group's quantiles are shrunk
towards its language's, and those towards everything's, by a weight in
documents, so a group moves away from its language as it grows, without a step.

Median and quartiles bear a group of which nearly a quarter is junk.  A count c
of n fails where sqrt(c) > sqrt(n * usual) + slack: ``usual`` is the rate up to
which the group's quartile explains it, and the square roots make the slack the
same number of standard deviations for a short text and for a long one.  The mean
word length fails outside its group's median by a multiple of the quartile
distance, wider for short texts.

Defined cases: a null or empty text has no words and fails the base rule.  Null
language or source is a group of its own, apart from any value.  Repeated rows
are judged each for itself.  An empty table gives an empty result.  Other columns
are untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, let, store

PPM = 1_000_000
WINDOW = 8
METRICS = ("symbol_ppm", "dup_line_ppm", "repeat_ppm", "top_word_ppm", "word_len_milli")


@dataclass(frozen=True)
class Rules:
    """Limits are made from quantiles at ``quartiles`` of a document's language and source."""

    min_words: int = 20
    max_repeat_percent: int = 30
    weight: int = 200  # documents of the larger group that shrink a group's quantiles
    quartiles: tuple[float, float, float] = (0.25, 0.50, 0.75)
    spread: float = 2.0  # usual rate: ``spread`` * (upper quartile + ``least``)
    slack: float = 2.5  # standard deviations of a count over what is usual
    #: Smallest differences of the four shares that mean anything, in millionths.
    least: tuple[int, ...] = (5_000, 50_000, 50_000, 10_000)
    #: How many units of a count come at once: a repeated window has its words in both places.
    clump: tuple[int, ...] = (1, 1, 2 * 8, 1)
    len_spread: float = 4.0
    len_least: int = 100  # thousandths of a letter
    len_short: float = 4_000.0  # widens the range of mean word lengths by this over sqrt(words)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            starts,
            lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts_of(pairs: Column) -> Column:
        hit = F.filter(
            F.transform(
                pairs,
                lambda p, k: F.when(
                    (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]), p["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return F.sort_array(hit)

    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # most texts repeat nothing; only the others are sorted
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(let(pairs, starts_of), covered)
        )

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    return F.when(F.size(words) >= WINDOW, let(hashes, found)).otherwise(F.lit(0).cast("long"))


def _top_word(words: Column) -> Column:
    """How often the most frequent word of four letters or more occurs."""
    run = F.sort_array(F.filter(words, lambda w: F.length(w) >= 4))

    def longest(sorted_words: Column) -> Column:
        done = F.aggregate(
            sorted_words,
            F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("m")),
            lambda a, w: F.struct(
                w.alias("w"),
                F.when(a["w"] == w, a["n"] + 1).otherwise(1).alias("n"),
                F.greatest(a["m"], F.when(a["w"] == w, a["n"] + 1).otherwise(1)).alias("m"),
            ),
        )
        return done["m"]

    return let(run, longest)


def measures(text: Column) -> Column:
    """Struct of the counts of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            _top_word(words).cast("long").alias("n_top_word"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return F.struct(let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("s"))


def _rates(m: Column) -> Column:
    w, line = m["w"], m["l"]
    per = lambda a, b, k: F.floor(a * k / F.greatest(b, F.lit(1))).cast("long")
    return F.array(
        per(m["s"], w["word_chars"], PPM),
        per(line["n_dup_lines"], line["n_lines"], PPM),
        per(w["n_repeat_words"], w["n_words"], PPM),
        per(w["n_top_word"], w["n_words"], PPM),
        per(w["word_chars"], w["n_words"], 1000),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct ``q_m`` of counts and array ``q_rates`` of the rates in METRICS.

    Store the result before it is read twice: the counts cost far more than a scan.
    """
    both = let(measures(F.col(text)), lambda m: F.struct(m.alias("m"), _rates(m).alias("rates")))
    return docs.withColumn("q_both", both).withColumns({"q_m": F.col("q_both.m"), "q_rates": F.col("q_both.rates")}).drop("q_both")


def bucket(value: Column) -> Column:
    """Lower end of a value's sketch bucket: the value itself, or its seven leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0)).cast("int")
    return F.when(value < 128, value).otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))


def sketches(rated: DataFrame, rates: str, *keys: str) -> DataFrame:
    """Rows (keys..., metric, bucket, n): the sketch of each rate and group, partly summed before the shuffle."""
    one = rated.select(*keys, F.posexplode(rates).alias("metric", "value"))
    return one.groupBy(*keys, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketch of the larger groups ``keys``: the sum of its parts."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, probabilities: dict[str, float], *keys: str) -> DataFrame:
    """Rows (keys..., metric, total, one column for each quantile). A group is its few hundred buckets, however many rows it has."""
    w = Window.partitionBy(*keys, "metric")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    cuts = [
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), F.col("bucket"))).alias(name)
        for name, p in probabilities.items()
    ]
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *cuts)


def _shrunk(n: Column, own: Column, wider: Column, weight: int) -> Column:
    return (n * own + F.lit(weight) * wider) / (n + F.lit(weight))


def limits(rated: DataFrame, rules: Rules) -> DataFrame:
    """One row (g_lang, g_source, q_limits) for each group of ``rated`` (q_lang, q_source, q_rates).

    q_limits: the usual rate of each share, then the middle of the mean word lengths and their range.
    """
    fine = store(sketches(rated, "q_rates", "q_lang", "q_source"), "quality-sketch")
    names = ("lo", "mid", "hi")
    probabilities = dict(zip(names, rules.quartiles, strict=True))
    everything = quantiles(merge(fine), probabilities).select("metric", *[F.col(c).alias(f"all_{c}") for c in names])
    by_lang = quantiles(merge(fine, "q_lang"), probabilities, "q_lang").join(F.broadcast(everything), "metric")  # five rows
    by_lang = by_lang.select(F.col("q_lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[_shrunk(F.col("total"), F.col(c), F.col(f"all_{c}"), rules.weight).alias(f"lang_{c}") for c in names])
    one = quantiles(fine, probabilities, "q_lang", "q_source")
    one = one.join(by_lang, F.col("q_lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    shrunk = [_shrunk(F.col("total"), F.col(c), F.col(f"lang_{c}"), rules.weight).alias(c) for c in names]
    grouped = one.groupBy("q_lang", "q_source").agg(F.sort_array(F.collect_list(F.struct("metric", *shrunk))).alias("q"))  # five a group
    at = lambda k, c: F.get("q", F.lit(k))[c]
    usual = [F.lit(rules.spread) * (at(k, "hi") + F.lit(rules.least[k])) for k in range(4)]
    around = F.lit(rules.len_spread) * (at(4, "hi") - at(4, "lo") + F.lit(rules.len_least))
    return grouped.select(F.col("q_lang").alias("g_lang"), F.col("q_source").alias("g_source"), F.array(*usual, at(4, "mid"), around).alias("q_limits"))


def base_failed(rules: Rules) -> Column:
    w = F.col("q_m.w")
    return (w["n_words"] < rules.min_words) | (100 * w["n_repeat_words"] > rules.max_repeat_percent * w["n_words"])


def kept(rules: Rules) -> Column:
    w, line = F.col("q_m.w"), F.col("q_m.l")
    counts = ((F.col("q_m.s"), w["word_chars"]), (line["n_dup_lines"], line["n_lines"]), (w["n_repeat_words"], w["n_words"]), (w["n_top_word"], w["n_words"]))
    inside = ~F.col("base_failed")
    for k, (c, n) in enumerate(counts):
        usual = n * F.get("q_limits", F.lit(k)) / F.lit(float(PPM * rules.clump[k]))
        inside &= F.sqrt(c / F.lit(float(rules.clump[k]))) <= F.sqrt(usual) + F.lit(rules.slack)
    off = F.abs(F.get("q_rates", F.lit(4)) - F.get("q_limits", F.lit(4)))
    inside &= off <= F.get("q_limits", F.lit(5)) + F.lit(rules.len_short) / F.sqrt(F.greatest(w["n_words"], F.lit(1)).cast("double"))
    return F.coalesce(inside, F.lit(False))  # a group whose documents all fail the base rule has no limits


def _judged(rated: DataFrame, rules: Rules, broadcast_rows: int) -> DataFrame:
    """Stored rows (q_lang, q_source, q_m, q_rates, ...) with base_failed, kept and q_limits.

    Limits are one small row for each language and source: up to
    ``broadcast_rows`` of them (counted first) go to every task, more are
    joined by a shuffle.
    """
    rated = rated.withColumn("base_failed", base_failed(rules))
    lim = store(limits(rated.filter(~F.col("base_failed")).select("q_lang", "q_source", "q_rates"), rules), "quality-limits")
    lim = F.broadcast(lim) if lim.count() <= broadcast_rows else lim
    same = F.col("q_lang").eqNullSafe(F.col("g_lang")) & F.col("q_source").eqNullSafe(F.col("g_source"))
    return rated.join(lim, same, "left").drop("g_lang", "g_source").withColumn("kept", kept(rules))


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", broadcast_rows: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: key, counts, base_failed, kept, rates and limits.

    The counts are written once; sketch and filter both read them.
    """
    rated = measured(docs.select(F.col(key), F.col(text).alias("q_text"), F.col(lang).alias("q_lang"), F.col(source).alias("q_source")), "q_text").drop("q_text")
    return _judged(store(rated, "quality-rates"), rules, broadcast_rows)


def keep(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source", broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that pass, whole and with their own columns.

    Rows are written once with their counts; sketch and filter read them back.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("q_text"), F.col(lang).alias("q_lang"), F.col(source).alias("q_source"))
    rated = store(measured(rows, "q_text").drop("q_text"), "quality-rows")
    return _judged(rated, rules, broadcast_rows).filter("kept").select("row.*")
