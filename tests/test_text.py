import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import pairs, segment


def frame(spark, *pairs_of_text):
    rows = [(k, "de", a, b) for k, (a, b) in enumerate(pairs_of_text)]
    return spark.createDataFrame(rows, "pair_id long, lang string, text_a string, text_b string")


def side_a(spark, text):
    t = segment.tokens(pairs.sides(frame(spark, (text, ""))))
    return t.filter("side = 'a'").orderBy("idx")


@pytest.mark.parametrize("text", ["Hello  world , again .", " a\x1cb c \U0001f600 d\n", "x", "", "a b\tc"])
def test_tokens_have_pythons_offsets(spark, text):
    got = [(r["tok"], r["start"], r["end"]) for r in side_a(spark, text).collect()]
    assert got == [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def test_punctuation_is_one_ascii_character(spark):
    import string

    yes, no = list(string.punctuation), ["a", "Z", "7", "..", "a.", "“", "·", "", "é"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", T.is_punctuation(F.col("t")).alias("p")).collect()}
    assert all(got[t] for t in yes) and not any(got[t] for t in no)


@pytest.mark.parametrize(
    ("text", "sizes"),
    [
        ("Rain fell all day ! Streets stayed wet", [5, 3]),
        ("see e.g. page nine . Done", [5, 1]),
        ("title\nbody text . more\n\nlast", [1, 3, 1, 1]),
        ("b) first of everything. (2) second one?", [4, 3]),
        ("ends here.” Next", [2, 1]),
        ("   ", []),
    ],
)
def test_segments(spark, text, sizes):
    s = segment.segments(side_a(spark, text)).orderBy("seg").collect()
    assert [r["tok_hi"] - r["tok_lo"] for r in s] == sizes
    assert all(r["text"] in text for r in s)


def test_similarity_of_known_texts(spark):
    def sim(a, b):
        df = spark.createDataFrame([(a, b)], "a string, b string")
        sets = [F.array_distinct(T.norm_tokens(F.col(c))) for c in "ab"]
        return df.select(T.lexical_similarity(*sets).alias("s")).first()["s"]

    assert sim("water", "wasser") == pytest.approx(0.9)
    assert sim("the same words", "the same words") == 1.0
    assert sim("", "x") == 0.0
    assert sim("12 apples", "12 pears") == pytest.approx(1.0)  # a shared number counts as word and as number
    assert sim("7 apples", "12 pears") == pytest.approx(0.25)


def test_noise_is_small_and_stable(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    assert df.select(T.hash8(F.col("a"), F.col("b"), F.lit("0")).alias("h")).first()["h"] == 3219307723
    assert abs(df.select(T.noise(F.col("a"), F.col("b")).alias("n")).first()["n"]) <= 0.15
