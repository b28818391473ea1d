import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, fp string, q_m int, next int, shard string, _group int, row string, key long, file string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, odd characters, and columns named as internals."""
    long = " ".join(f"word{k % 900} of, a long text." for k in range(6000))
    rows = [
        (1, "The same text, twice. It has more than twenty words so that rules of length do not take it away from us today.", "en", "s1"),
        (2, "The same text, twice. It has more than twenty words so that rules of length do not take it away from us today.", "en", "s1"),
        (3, None, "en", None), (4, "", None, "s1"), (5, long, "en", "s2"), (6, "\t\n  ", "fr", "s2"),
        (7, "Ünïcödé é ﬁ Straße　x \x1c y\x00z <|endoftext|> 日本語 😀", "de", "s1"), (None, "no id here, but text", "en", "s1"),
        (8, "one two three four five six seven eight one two three four five six seven eight", "en", "s2"), (9, "x", "xx", "s3"), (9, "x", "xx", "s3"),
        (10, "line a b c\nline a b c\nother\n\nline a b c", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, None, "b", "f", 1, 2, "s", 0, "r", 7, "f") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("false")
