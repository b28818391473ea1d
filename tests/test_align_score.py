import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import align, baseline, judge, pairs, score, segment, similarity
from plumbline.operators.stored import stored


def cells(matrix):
    return len(matrix), len(matrix[0]) if matrix else 0, {(i, j): v for i, row in enumerate(matrix) for j, v in enumerate(row)}


def ops(matrix):
    return align.align(*cells(matrix))


def kinds(matrix):
    return [o[0] for o in ops(matrix)]


def test_each_operation_where_it_is_cheapest():
    high, low = 0.95, 0.05
    assert ops([[high, low], [low, high]]) == [("1:1", 0, 1, 0, 1, high), ("1:1", 1, 2, 1, 2, high)]
    # one A against two halves, and the other way round, between two plain matches
    split = [[high, low, low, low], [low, high, high, low], [low, low, low, high]]
    assert kinds(split) == ["1:1", "1:2", "1:1"] and kinds([list(c) for c in zip(*split)]) == ["1:1", "2:1", "1:1"]
    # a segment without a counterpart costs less left out than matched below the floor
    assert kinds([[high, low], [low, low], [low, high]]) == ["1:1", "1:0", "1:1"] and kinds([[high, low, low], [low, low, high]]) == ["1:1", "0:1", "1:1"]
    assert align.align(2, 0, {}) == [("1:0", 0, 1, -1, -1, 0.0), ("1:0", 1, 2, -1, -1, 0.0)]
    assert align.align(0, 2, {}) == []  # without an A side nothing is emitted


def test_pairs_aligned_together_are_aligned_as_alone(monkeypatch):
    monkeypatch.setattr(align, "GROUP_CELLS", 300)
    r = random.Random(9)
    many = [cells([[round(r.random(), 1) for _ in range(r.randrange(1, 9))]] * r.randrange(1, 7)) for _ in range(40)]
    arrays = [tuple(map(__import__("numpy").array, ([i for i, _ in c], [j for _, j in c], list(c.values())))) for _, _, c in many]
    assert align.align_many([(n, m) for n, m, _ in many], arrays) == [align.align(*x) for x in many]


def test_random_matrix_is_covered_in_order_at_least_cost():
    r = random.Random(23)
    n, m, known = cells([[r.random() for _ in range(9)] for _ in range(7)])
    found = align.align(n, m, known)
    for side, size in ((1, n), (3, m)):
        used = [k for o in found for k in range(o[side], o[side + 1]) if o[side] >= 0]
        assert used == list(range(size))

    def least(i, j, memo={}):  # noqa: B006
        """Cost of the best way to (i, j), from the definition."""
        if (i, j) == (0, 0):
            return 0.0
        if (i, j) not in memo:
            s = lambda a, b: known[a, b]
            ways = []
            if i and j:
                ways.append(least(i - 1, j - 1) + 1 - s(i - 1, j - 1) + (0.35 if s(i - 1, j - 1) < 0.15 else 0))
            if i and j > 1:
                ways.append(least(i - 1, j - 2) + 1.2 - (s(i - 1, j - 2) + s(i - 1, j - 1)) / 2)
            if i > 1 and j:
                ways.append(least(i - 2, j - 1) + 1.2 - (s(i - 2, j - 1) + s(i - 1, j - 1)) / 2)
            if i:
                ways.append(least(i - 1, j) + 0.55)
            if j:
                ways.append(least(i, j - 1) + 0.55)
            memo[i, j] = min(ways)
        return memo[i, j]

    spent = 0.0
    for o, a0, a1, b0, b1, sim in found:
        spent += 0.55 if o in ("1:0", "0:1") else 1 - sim + (0.2 if o != "1:1" else 0.35 if sim < 0.15 else 0)
    assert spent == pytest.approx(least(n, m))


def run(spark, a, b):
    df = spark.createDataFrame([("p", "de", a, b)], "pair_id string, lang string, text_a string, text_b string")
    sides = pairs.sides(df)
    tokens = segment.tokens(sides)
    segs = segment.segments(tokens)
    sizes = similarity.sizes(segs)
    scored = similarity.scored(similarity.candidates(sizes), segs)
    found = align.operations(sizes, scored)
    return sides, tokens, found, judge.judgments(found, segs)


def test_a_pair_end_to_end(spark):
    a, b = "Trains run late . Nobody minds .", "Züge fahren spät . Keiner klagt . Warum ."
    sides, tokens, found, judged = run(spark, a, b)
    labels = score.token_labels(tokens, found, judged, sides).collect()
    assert len(labels) == len(a.split()) + len(b.split())
    assert all(r["label"] == -1 if r["tok"] == "." else 0 <= r["label"] <= 1 for r in labels)
    assert align.coverage(found).first()[1:3] == (True, True)


def test_pairs_with_an_empty_side(spark):
    _, _, found, _ = run(spark, "One . Two .", "")
    assert [r["op"] for r in found.orderBy("op_idx").collect()] == ["1:0", "1:0"]
    sides, tokens, found, judged = run(spark, "", "One . Two .")
    assert found.count() == 0
    assert {r["label"] for r in score.token_labels(tokens, found, judged, sides).collect()} == {0.0, -1.0}


def test_scores_with_given_judgments(spark):
    sides = pairs.sides(spark.createDataFrame([("p", "de", "red green", "rot blau")], "pair_id string, lang string, text_a string, text_b string"))
    tokens = segment.tokens(sides)
    op = spark.createDataFrame([("p", 0, "1:1", 0, 1, 0, 1, 0.25)], "pair_id string, op_idx int, op string, a_start int, a_end int, b_start int, b_end int, sim double")
    schema = "pair_id string, op_idx int, difference int, span_a string, span_b string, tok_lo_a int, tok_hi_a int, char_lo_a int, tok_lo_b int, tok_hi_b int, char_lo_b int"
    judged = spark.createDataFrame([("p", 0, 3, "green", None, 0, 2, 0, 0, 2, 0)], schema)
    cfg = score.ScoreConfig(span_boost=0.15, span_floor=0.7)
    got = score.token_labels(tokens, op, judged, sides, cfg).orderBy("side", "idx").collect()
    assert [round(r["label"], 6) for r in got] == [0.6, 0.75, 0.6, 0.6]
    without = score.token_labels(tokens, op, judged.filter("false"), sides).collect()
    assert {round(r["label"], 6) for r in without} == {0.75}


def test_band(spark):
    sizes = spark.createDataFrame([("p", "de", 20, 20), ("q", "de", 3, 3)], "pair_id string, lang string, n int, m int")
    got = {(r["pair_id"], r["i"], r["j"]) for r in similarity.candidates(sizes).collect()}
    want = {(p, i, j) for p, n in (("p", 20), ("q", 3)) for i in range(n) for j in range(n) if abs(i / max(n - 1, 1) - j / max(n - 1, 1)) <= 0.2 or abs(i - j) <= 2}
    assert got == want and len([g for g in got if g[0] == "p"]) < 240


def test_baseline_labels(spark):
    df = spark.createDataFrame([("p", "de", "same 42 ... other", "Same! thing")], "pair_id string, lang string, text_a string, text_b string")
    got = {(r["side"], r["tok"]): r["code"] for r in baseline.labels(segment.tokens(pairs.sides(df))).collect()}
    assert got["a", "same"] == got["b", "Same!"] == got["a", "42"] == 5 and got["a", "..."] == -1 and got["a", "other"] in (1, 2)


def sparse(known):
    import numpy as np

    return tuple(np.array(x) for x in ([i for i, _ in known], [j for _, j in known], list(known.values()))) if known else (np.empty(0, int), np.empty(0, int), np.empty(0))


def test_long_pairs_are_aligned_as_short_ones(monkeypatch):
    """Ties, empty sides and cells beyond the band included."""
    r = random.Random(31)
    for _ in range(150):
        n, m = r.randint(0, 13), r.randint(0, 13)
        known = {(i, j): r.choice([0, 0.05, 0.1, 0.3, 0.5, 0.8, 0.9, round(r.random(), 1)]) for i in range(n) for j in range(m) if r.random() < 0.6}
        want = align.align_many([(n, m)], [sparse(known)])[0]
        assert not n or align.align_long(n, m, sparse(known)) == want
        monkeypatch.setattr(align, "GROUP_CELLS", 40)
        assert align.align_many([(n, m), (2, 2)], [sparse(known), sparse({(0, 0): 0.9, (1, 1): 0.9})]) == [want, [("1:1", 0, 1, 0, 1, 0.9), ("1:1", 1, 2, 1, 2, 0.9)]]
        monkeypatch.undo()


def test_a_long_pair_needs_memory_for_its_band_only():
    import tracemalloc

    n = 3000
    known = {(i, j): 0.9 if i == j else 0.2 for i in range(n) for j in range(max(0, i - 2), min(n, i + 3))}
    tracemalloc.start()
    found = align.align_long(n, n, sparse(known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [o[0] for o in found] == ["1:1"] * n and peak < 20e6  # 9 million cells of choices and 72 MB of similarities if dense


def test_cells_are_counted_without_being_made(spark):
    """For every size of a small matrix, and where the two stretches of the band lie apart."""
    z = spark.createDataFrame([(f"{n}-{m}", "de", n, m) for n in range(0, 24) for m in [*range(0, 24), 100, 333]], "pair_id string, lang string, n int, m int")
    want = {r["pair_id"]: r["count"] for r in similarity.candidates(z).groupBy("pair_id").count().collect()}
    counted = similarity.counted(z)
    assert {r.pair_id: r.n_cells for r in counted.collect()} == want
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # rows, not cells


def test_tokens_carry_only_their_segments_operation(spark):
    """Segments meet their operations before tokens are cut: the rows of tokens that are joined, without arrays of a pair's segments."""
    df = spark.createDataFrame([("p", "de", "One two. Three! Four five. 6 - x.", "Eins zwei. Drei! Mehr. 6."), ("q", "de", "Only here.", "")], "pair_id string, lang string, text_a string, text_b string")
    sides = pairs.sides(df)
    segments = segment.segments_of(sides)
    ops = align.operations_from(segments)
    judged = judge.judgments(ops, segments)
    got = score.token_labels(segments, ops, judged, sides)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, score.token_labels(segment.tokens_of(segments), ops, judged, sides).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join LeftOuter")


def kept_steps(spark):
    df = spark.createDataFrame([("p", "de", "One two. Three! Four five. 6 - x.", "Eins zwei. Drei! Mehr. 6."), ("q", "de", "Only here.", "")], "pair_id string, lang string, text_a string, text_b string")
    sides = stored(pairs.sides(df), "sides")
    segments = stored(segment.segments_of(sides), "segments")
    ops = stored(align.operations_from(segments), "operations")
    return sides, segments, ops


def test_operations_are_not_broadcast_for_their_passages_and_spans(spark):
    """A stored step looks as small as its compressed files; millions of operations went through the driver to all tasks."""
    sides, segments, ops = kept_steps(spark)
    judged = stored(judge.judgments(ops, segments), "judgments")
    for step in (judge.passages(ops, segments), align.op_tokens(ops, segments), score.span_places(judged, sides)):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert step.count()


def test_operations_are_not_broadcast_for_labels(spark):
    """The same where segments meet their operations, judgments and spans."""
    sides, segments, ops = kept_steps(spark)
    judged = stored(judge.judgments(ops, segments), "judgments")
    levels = score.token_levels(segments, ops, judged, sides)
    plan = levels._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "Broadcast" not in plan
    assert levels.count() == sides.selectExpr("sum(size(split(trim(text), ' ')))").first()[0] - 1  # the empty text has no token
