"""Tokens and segments cut by the Arrow step, against the expressions of `text` and plain Python."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import cutting
from plumbline.functions import text as T
from plumbline.operators import pairs, segment

SPACE = T.WS.replace(r"\x{", "{")
SPACE = re.sub(r"\{([0-9a-f]+)\}", lambda m: "\\u" + m[1].zfill(4), SPACE)
TEXTS = [
    "", "   ", "one", " A b. C d!  (E.)\n\nF e.g. g a) h 12. Z", "x　y z\u0085w v u", "«Satz.» Neu… 東京。！ ende", "a.\n", "\n\n a", "İ. K. É Ü? c.-à-d. x\x1cy",
    "no end " * 3000, "Eins. Zwei. " * 2000, "Â\u0085b \u0080x  ", "tab\tsep\r\nline. next",
]


def plain(text):
    """(piece, tok, start, end, seg) by a loop."""
    found = list(re.finditer(f"[{SPACE}]*([^{SPACE}]+)", text))
    out, seg = [], 0
    for k, m in enumerate(found):
        out.append({"piece": m[0], "tok": m[1], "start": m.start(1), "end": m.end(1), "seg": seg})
        if k + 1 < len(found) and ("\n" in found[k + 1][0] or cutting.ends_sentence(m[1])):
            seg += 1
    return out


@pytest.mark.parametrize("block", [1, 64, 1 << 22])
def test_tokens_of_many_texts(block, monkeypatch):
    monkeypatch.setattr(cutting, "BLOCK", block)
    texts = pa.array([None, *TEXTS, None])[1:]
    struct = pa.struct([("piece", pa.string()), ("tok", pa.string()), *[(k, pa.int32()) for k in ("start", "end", "seg")]])
    got = cutting._blocks(texts, cutting._tokens, struct).to_pylist()
    assert got == [*map(plain, TEXTS), None]


def test_sentence_ends_as_expression(spark):
    words = sorted({t["tok"] for x in TEXTS for t in plain(x)} | set(T.ABBREVIATIONS) | {"(1)", "b.)", "ab:", ".", "...", "]", "etc.)", "ABC.", "Z.B.", "?!\"", "K."})
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.ends_sentence(F.col("w"))).collect()}
    assert got == {w: cutting.ends_sentence(w) for w in words}


def test_segments_of_texts_need_no_tokens(spark):
    d = spark.createDataFrame([(k, "de", t, TEXTS[-k - 1]) for k, t in enumerate(TEXTS)], "pair_id long, lang string, text_a string, text_b string")
    sides = pairs.sides(d)
    found = segment.segments_of(sides)
    key = ["pair_id", "side", "seg"]
    assert found.orderBy(key).collect() == segment.segments(segment.tokens(sides)).orderBy(key).collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan and "Window" not in plan
    placed = segment.places(sides)
    key = ["pair_id", "side", "idx"]
    assert placed.orderBy(key).collect() == segment.tokens(sides).orderBy(key).collect()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_tokens_of_segments_and_texts(spark):
    d = spark.createDataFrame([(k, "de", t, TEXTS[-k - 1]) for k, t in enumerate(TEXTS)], "pair_id long, lang string, text_a string, text_b string")
    sides = pairs.sides(d)
    key = ["pair_id", "side", "idx"]
    columns = ["pair_id", "lang", "side", "idx", "tok", "seg"]
    want = segment.tokens(sides).orderBy(key).select(columns).collect()
    found = segment.tokens_of(segment.segments_of(sides))
    assert found.orderBy(key).select(columns).collect() == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert segment.words(sides).orderBy(key).collect() == [r[:5] for r in want]


def test_segments_are_counted_as_they_are_cut(spark):
    texts = ["", None, "a", "a. b! c\n\nd e.g. f. ", "\n \n", "x " * 9, "one. two. three"]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(1)
    got = d.select("k", cutting.segment_count(F.col("text")).alias("n"), F.coalesce(F.size(cutting.segments(F.col("text"))), F.lit(0)).alias("want")).collect()
    assert {r.k: r.n for r in got} == {r.k: max(r.want, 0) for r in got} and max(r.n for r in got) > 2
