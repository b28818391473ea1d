"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

No pair of near words is ever made a row of its own group's square:

* replacements: words that agree but for the code point at one position meet in
  a group (position, prefix, suffix).  The group's size tells each member how
  many near words it has there, and its first two words which is the best of
  them: the first, or for the first itself the second.  A pair of words shares
  one group at most, so the numbers add up.
* insertions and deletions: a word's deletion variants (a row each; of a
  stretch of one repeated code point one only) are joined with the vocabulary
  by equality, and a hit counts for both words.

Words carry an id that ascends from the most frequent word down, equal counts
in code-point order, so "the best near word" is the smallest id and every step
moves longs.  Words longer than KEY_CHARS take part under digests of their
prefix and suffix, so a very long word costs its length, not its square, in
each row.  A group of replacements has at most as many members as the alphabet.

Defined cases: null and empty texts have no words; a null document id makes the
edit of an `edited_word` null, and the word stays; an empty table has no words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Runs of basic Latin letters and U+00C0 to U+00FF, of which A-Z is lower-cased first.
LETTERS = "[a-zÀ-ÿ]+"
KEY_CHARS = 32


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_counts(docs: DataFrame, text: str = "text", word: Column | None = None, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least ``min_chars`` code points that occur ``min_count`` times or more.

    ``word`` may derive the word to count from the columns of ``docs`` and ``run``, the letters found in the text.
    """
    runs = docs.withColumn("run", F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))))
    words = runs.select((F.col("run") if word is None else word).alias("word")).filter(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _part(text: Column) -> Column:
    """A prefix or suffix in a key: itself, or a digest where the whole word is long."""
    return F.when(F.char_length("word") <= KEY_CHARS, text).otherwise(F.sha2(text, 256))


def _around(at: Column) -> tuple[Column, Column]:
    return F.substring("word", F.lit(1), at - 1), F.substring("word", at + 1, F.char_length("word"))


def replacement_groups(words: DataFrame) -> DataFrame:
    """(id, near, best): for each word and position, how many words differ there only, and the smallest id of them."""
    at = F.col("at")
    prefix, suffix = _around(at)
    open_at = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("word"))))
    members = open_at.select("id", F.concat_ws("*", F.when(F.char_length("word") > KEY_CHARS, at), _part(prefix), _part(suffix)).alias("wildcard"))
    group = Window.partitionBy("wildcard")
    ordered = group.orderBy("id")
    stated = members.select(
        "id",
        F.count(F.lit(1)).over(group).alias("size"),
        F.first("id").over(ordered).alias("top"),
        F.nth_value("id", 2).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("second"),
    )
    return stated.filter("size > 1").select("id", (F.col("size") - 1).alias("near"), F.when(F.col("id") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))


def deletion_hits(words: DataFrame) -> DataFrame:
    """(id, near, best) of both words for every word that is another without one code point."""
    at = F.col("at")
    prefix, suffix = _around(at)
    open_at = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("word"))))
    # of a stretch of one code point only the last can go: the others leave the same word
    last = open_at.filter(F.substring("word", at, F.lit(1)) != F.substring("word", at + 1, F.lit(1)))
    whole = lambda c, long: F.when(~long, c).otherwise(F.sha2(c, 256))
    shorter = last.select(F.col("id").alias("longer"), whole(F.concat(prefix, suffix), F.char_length("word") - 1 > KEY_CHARS).alias("key"))
    known = words.select(F.col("id").alias("shorter"), whole(F.col("word"), F.char_length("word") > KEY_CHARS).alias("key"))
    side = lambda a, b: F.struct(F.col(a).alias("id"), F.lit(1).cast("long").alias("near"), F.col(b).alias("best"))
    return shorter.join(known, "key").select(F.inline(F.array(side("longer", "shorter"), side("shorter", "longer"))))


def follow(links: DataFrame) -> DataFrame:
    """(id, root): where the links (id, to), each to a smaller id, end. Every round doubles the length of the paths walked."""
    now = links.select("id", F.col("to").alias("root"))
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = store(now.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("id", "root")
        if step.filter("moved").isEmpty():
            return now


def group_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n; words distinct).

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``ratio`` times the word's own; ``root`` the last word
    that forms lead to, the word itself without one.
    """
    words = store(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")
    near = replacement_groups(words).unionByName(deletion_hits(words)).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    best = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = store(words.join(near, "id", "left").join(best, "best", "left"), "spelling-near")
    formed = F.col("form_n") >= ratio * F.col("n")
    roots = follow(known.filter(formed).select("id", F.col("best").alias("to")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return known.join(named, "id", "left").select(
        "word",
        F.when(formed, F.col("form")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("form_n")).alias("form_n"),
    )


def edited_word(key: Column, every: int) -> Column:
    """Column ``run`` without one code point where ``every`` divides the crc32 of ``key:run``; the code point is that crc32 modulo the run's length."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
