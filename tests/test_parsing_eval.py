import math
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import parsing as P
from plumbline.operators import evaluate, guard, resample, runs


def test_first_json():
    assert P.first_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert P.first_json('so: {"a": {"b": "}"}} and {"c": 2}') == {"a": {"b": "}"}}
    assert P.first_json("none") is P.first_json('{"a": 1') is P.first_json(None) is None


def test_judgments():
    reply = '{"semantic_difference": 2.5, "differing_spans": {"side_a": ["x", "no"], "side_b": null}}'
    assert P.judgment(reply, "a x b", "c") == (2, ["x"], [])
    for bad in ("9", '"high"', "true", "NaN", "-1"):
        assert P.judgment(f'{{"semantic_difference": {bad}}}', "", "") is None


def test_scores_last_wins():
    assert P.scores('{"scores": [{"i": 0, "j": 1, "score": 2}, 5, {"i": 0}, {"i": 0, "j": 1, "score": 3}]}') == {(0, 1): 3.0}


def walked(tokens, *entries, fallback=9):
    return P.walk_labels(tokens.split(), list(entries), fallback)


def test_label_walk():
    assert walked("to be or not", ["to", 1], ["be", 2], ["or", 3], ["not", 4]) == [1, 2, 3, 4]
    assert walked("to be or not", ["be", 2], ["not", 4]) == [9, 2, 9, 4]  # the token after the cursor may be meant
    assert walked("to be or not", ["not", 4], ["to", 1]) == [1, 9, 9, 9]  # what lies further is passed over
    assert walked("to be", "to", ["be"], ["be", 3]) == [9, 9]  # a name alone moves on without a label
    assert walked("to be", ["to", {}], ["to", 2]) == [2, 9]  # a label that is no number leaves the cursor
    assert walked("to be", 3, None, [], [4, 4], ["to", "1.5"]) == [1.5, 9]
    assert P.walk_labels(["to"], None, 0.0) == [0.0]


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.tuples(st.sampled_from("abcx"), st.integers(0, 5)).map(list), max_size=8))
def test_label_walk_never_fails(tokens, entries):
    assert len(P.walk_labels(tokens, entries)) == len(tokens)


def test_salvage_and_walker(spark):
    broken = '{"sentence1": [["one [", 4], ["two", "0.5"], ["three", null], ["four" 1], "sentence2": [["five", 2], ['
    assert P.salvage(broken, "sentence1") == [["one [", 4.0], ["two", 0.5]] and P.salvage(broken, "sentence2") == [["five", 2.0]] and P.salvage(broken, "none") == []
    assert P.salvage('{"sentence1": [["a", 1], ["b", 2]], "x', "sentence1") == [["a", 1.0], ["b", 2.0]]
    df = spark.createDataFrame([(["one [", "two"], broken), (["d"], '{"sentence1": [["d", 0]]}')], "t array<string>, r string")
    assert [r[0] for r in df.select(P.label_walker()(F.col("t"), F.col("r"), "sentence1")).collect()] == [[4.0, 0.5], [0.0]]


@given(st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["semantic_difference", "differing_spans", "side_a", "side_b", "scores", "i"]), x, max_size=4)))
def test_hostile_replies_never_fail(value):
    import json

    reply = json.dumps(value)
    for r in (reply, reply[: len(reply) // 2], '{"semantic_difference": 1e999}', '{"semantic_difference": 1, "differing_spans": {"side_a": 5}}', "[" * 5000):
        P.judgment(r, "a", "b"), P.scores(r), P.salvage(r, "sentence1")
    assert P.judgment('{"semantic_difference": 1e999}', "", "") is None and P.judgment('{"semantic_difference": 1, "differing_spans": {"side_a": 5}}', "", "") is None


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True))
    return sxy / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_correlations_match_their_definitions(spark):
    r = random.Random(3)
    rows = [("de", r.choice([0.0, 0.2, 0.6, 1.0]), r.choice([-1.0, 0.0, 0.4, 0.8])) for _ in range(300)] + [("fr", 0.5, 0.1)] * 4 + [("it", 0.1, 0.2)]
    df = spark.createDataFrame(rows, "lang string, pred double, gold double")
    cells = evaluate.table(df, "lang")
    pairs = [(p, g) for lang, p, g in rows if lang == "de" and g != -1]
    got = {x["lang"]: x["spearman"] for x in evaluate.spearman(cells, "lang").collect()}
    assert got["de"] == pytest.approx(pearson(ranks([p for p, _ in pairs]), ranks([g for _, g in pairs])), abs=1e-9)
    assert got["fr"] is None and got["it"] is None
    sign = lambda x: (x > 0) - (x < 0)
    c = tp = tg = 0
    for i, (p, g) in enumerate(pairs):
        for q, h in pairs[:i]:
            c += sign(p - q) * sign(g - h)
            tp += p != q
            tg += g != h
    tau = {x["lang"]: x["kendall"] for x in evaluate.kendall(cells, "lang").collect()}
    assert tau["de"] == pytest.approx(c / math.sqrt(tp * tg), abs=1e-9) and tau["fr"] is None
    assert tuple(evaluate.strict_macro(evaluate.spearman(cells, "lang"), 3).first())[0] is None


def test_padding_and_skipped_side(spark):
    schema = "pair_id string, lang string, labels_a array<double>, labels_b array<double>"
    gold = spark.createDataFrame([("1", "de", [0.1, 0.2, 0.3], [-1.0, -1.0]), ("2", "de", [0.5], [0.6])], schema)
    pred = spark.createDataFrame([("1", "de", [0.9], [0.9, 0.9]), ("2", "de", [0.4, 0.4], [0.3])], schema)
    got = Counter((r["pair_id"], r["side"], r["k"], r["pred"], r["gold"]) for r in evaluate.aligned(gold, pred).collect())
    assert got == Counter([("1", "a", 0, 0.9, 0.1), ("1", "a", 1, 0.0, 0.2), ("1", "a", 2, 0.0, 0.3), ("2", "a", 0, 0.4, 0.5), ("2", "b", 0, 0.3, 0.6)])
    assert tuple(evaluate.length_mismatches(gold, pred).first()) == ("de", 2, 2, 0)


def test_guards(spark, tmp_path):
    names = ["train", " Dev_VAL ", "dev/train", "test", "full", "val/test", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", guard.normal_split(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {"train": "dev/train", " Dev_VAL ": "dev/val", "dev/train": "dev/train"} | dict.fromkeys(names[3:])
    (tmp_path / "dev").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "dev")
    assert guard.assert_inside(str(tmp_path / "dev"), str(tmp_path))
    for bad in ("link", "..", "test/x"):
        with pytest.raises(guard.HeldOut):
            guard.assert_inside(str(tmp_path / bad), str(tmp_path))
    ids, known = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in ("ab", "a"))
    with pytest.raises(guard.HeldOut, match="b"):
        guard.assert_known(ids, known)


def test_budget_stops_between_batches(spark):
    requests = spark.range(50).withColumnRenamed("id", "n")
    call = lambda df: df.withColumn("tokens", F.lit(10))
    answers, capped = runs.within_budget(requests, "n", call, runs.Budget(max_requests=30))
    assert capped and sum(a.count() for a in answers) == 30
    answers, capped = runs.within_budget(requests, "n", call, runs.Budget(max_tokens=200))
    assert capped and len(answers) == 1 and answers[0].count() == 20
    answers, capped = runs.within_budget(requests, "n", call, runs.Budget())
    assert not capped and sum(a.count() for a in answers) == 50


def test_every_answer_is_paid_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def call(df):
        def run(frames):
            for f in frames:
                calls.add(len(f))
                yield f.assign(tokens=1)

        return df.mapInPandas(run, "n long, tokens long")

    budget = runs.Budget()
    answers, _ = runs.within_budget(spark.range(40).withColumnRenamed("id", "n"), "n", call, budget)
    assert sum(a.count() + len(a.collect()) for a in answers) == 80 and calls.value == budget.requests == budget.tokens == 40


def test_run_status(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "lang string, pair_id int")
    intended = rows(("de", 1), ("de", 2), ("fr", 3), ("it", 4), ("en", 5))
    s = runs.language_status(intended, rows(("de", 1), ("fr", 3)), rows(("de", 1), ("fr", 3), ("it", 4)))
    assert {r["lang"]: r["status"] for r in s.collect()} == {"de": "partial", "fr": "complete", "it": "started_no_output", "en": "not_started"}


def test_documents_are_drawn_once_for_both_systems_of_cells(spark):
    """Cells with a weight give what their tokens give."""
    r = random.Random(4)
    rows = [(f"p{k % 9}", ["de", "fr"][k % 2], r.choice([0.0, 0.5, 1.0]), r.choice([-1.0, 0.2, 0.6, 1.0])) for k in range(400)]
    one = spark.createDataFrame(rows, "pair_id string, lang string, pred double, gold double")
    two = one.withColumn("pred", 1 - F.col("gold"))
    counted = lambda d: evaluate.table(d, "lang", "pair_id")
    got = [[round(float(v), 9) for v in resample.paired_difference(a, b, 9).first()] for a, b in ((one, two), (counted(one), counted(two)))]
    assert got[0] == got[1] and got[0][0] > 0


def test_mismatches_of_sizes_are_those_of_labels(spark):
    rows = [("p0", "de", [0.1, 0.2], [-1.0], [0.1], [0.2, 0.3]), ("p1", "de", [0.1], [0.2], [0.1], []), ("p2", "fr", [], [0.4], [], [0.4])]
    d = spark.createDataFrame(rows, "pair_id string, lang string, labels_a array<double>, labels_b array<double>, pa array<double>, pb array<double>")
    want = evaluate.length_mismatches(d.select("pair_id", "lang", "labels_a", "labels_b"), d.select("pair_id", F.col("pa").alias("labels_a"), F.col("pb").alias("labels_b")))
    sizes = [(r[1], len(r[2]), len(r[3]), len(r[4]), len(r[5]), any(v != -1 for v in r[3])) for r in rows]
    got = evaluate.mismatches(spark.createDataFrame(sizes, "lang string, n_a int, n_b int, p_a int, p_b int, b_counts boolean"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("de", 2, 1, 1), ("fr", 1, 0, 0)]
