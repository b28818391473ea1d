"""Ranks, inversions, draws, cells by pair and spans in the row, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


from plumbline.functions import text as T
from plumbline.operators import align, baseline, batched, continuous, evaluate, model, pairs, resample, score, segment, similarity, waves


def cells(spark, rows):
    counted = Counter(rows)
    return spark.createDataFrame([(*k, w) for k, w in counted.items()], "lang string, pred double, gold double, w long").repartition(5)


def mean_ranks(values):
    order = sorted(values)
    return [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values]


def brute(rows):
    """Spearman and Kendall's tau-b from all pairs."""
    x, y = ([r[k] for r in rows] for k in (1, 2))
    rx, ry = (np.array(mean_ranks(v)) for v in (x, y))
    n = len(rows)
    rho = None if n < 2 or rx.std() == 0 or ry.std() == 0 else float(np.corrcoef(rx, ry)[0, 1])
    dx, dy = (np.sign(np.subtract.outer(v, v))[np.triu_indices(n, 1)] for v in (x, y))
    p, g = (dx != 0).sum(), (dy != 0).sum()
    return n, rho, None if not p or not g else float((dx * dy).sum() / math.sqrt(float(p)) / math.sqrt(float(g)))


def some_rows(seed):
    r = random.Random(seed)
    rows = [("a", r.random(), r.random()) for _ in range(300)]  # nothing twice
    rows += [("b", 0.5 if r.random() < 0.4 else r.random(), r.choice([0.0, 0.2, 0.4]) if r.random() < 0.7 else r.random()) for _ in range(400)]  # values that many share, on both sides
    rows += [("c", 1.0, r.random()) for _ in range(20)] + [("d", 0.1, 0.2)] + [("e", r.randrange(4) / 4, r.randrange(3) / 3) for _ in range(200)]
    return rows


@pytest.mark.parametrize("ranges", [2, 3, 8, 40])
def test_kendall_counts_every_pair_once(spark, ranges):
    rows = some_rows(ranges)
    got = {r["lang"]: r["kendall"] for r in continuous.kendall(cells(spark, rows), "lang", ranges=ranges).collect()}
    for lang in "abcde":
        want = brute([r for r in rows if r[0] == lang])[2]
        assert got[lang] == (None if want is None else pytest.approx(want, abs=1e-12)), lang


def test_spearman_and_ranks(spark):
    rows = some_rows(1)
    c = cells(spark, rows)
    got = {r["lang"]: (r["n"], r["spearman"]) for r in continuous.spearman(c, "lang").collect()}
    for lang in "abcde":
        n, rho, _ = brute([r for r in rows if r[0] == lang])
        assert got[lang][0] == n and got[lang][1] == (None if rho is None else pytest.approx(rho, abs=1e-9))
    b = [r[1] for r in rows if r[0] == "b"]
    ranked = {r["pred"]: r["rank"] for r in continuous.ranks(c, "pred", "lang").filter("lang = 'b'").collect()}
    assert ranked == dict(zip(b, mean_ranks(b), strict=True))


def test_many_values_and_few_agree(spark):
    rows = [r for r in some_rows(2) if r[0] == "e"]
    c = cells(spark, rows)
    assert continuous.kendall(c, "lang").first()["kendall"] == pytest.approx(evaluate.kendall(c, "lang").first()["kendall"])
    assert continuous.kendall(c.drop("lang")).first()["kendall"] == pytest.approx(evaluate.kendall(c.drop("lang")).first()["kendall"])
    assert continuous.kendall(c.filter("false"), "lang").collect() == []


def test_order_sums_by_hand():
    r = np.random.default_rng(0)
    for _ in range(100):
        n = int(r.integers(0, 40))
        x, y, w = r.integers(0, 9, n), r.integers(0, 9, n), r.integers(1, 5, n)
        want = sum(int(w[i] * w[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(n) for j in range(i))
        assert continuous.order_sum(x, y, w) == want


def test_no_range_has_much_more_than_its_share(spark):
    """Most rows share one value of either side: they are ranges of their own and go to no task."""
    r = random.Random(5)
    rows = [("a", 0.5 if r.random() < 0.5 else r.random(), 0.25 if r.random() < 0.5 else r.random()) for _ in range(6000)]
    c = cells(spark, rows)
    bounds = continuous.cuts(c, "pred", 16, "lang").first()["pred_cuts"]
    placed = c.join(continuous.cuts(c, "pred", 16, "lang"), "lang").withColumn("r", continuous.range_of(F.col("pred"), F.col("pred_cuts"), 16))
    sizes = {x["r"]: x["count"] for x in placed.groupBy("r").count().collect()}
    assert 0.5 in bounds and max(n for k, n in sizes.items() if k % 2 == 0) < 2 * c.count() / 16
    for x in placed.select("pred", "r").limit(500).collect():
        k = sum(b < x["pred"] for b in bounds)
        assert x["r"] == 2 * k + (x["pred"] in bounds)


def test_draws_are_poisson(spark):
    means = (0.3, 2.0, 29.0, 31.0, 400.0, 1e6)
    d = spark.createDataFrame([(m, k) for m in means for k in range(4000)], "m double, k int")
    got = defaultdict(list)
    for r in d.select("m", resample.poisson(F.col("m"), F.lit("seed"), F.col("k").cast("string")).alias("x")).collect():
        got[r["m"]].append(r["x"])
    for m, xs in got.items():
        assert all(x == int(x) and x >= 0 for x in xs)
        assert np.mean(xs) == pytest.approx(m, abs=5 * math.sqrt(m / 4000)) and np.var(xs) == pytest.approx(m, rel=0.12)
    for k in range(3):
        share = math.exp(-2.0) * 2.0**k / math.factorial(k)
        assert np.mean(np.array(got[2.0]) == k) == pytest.approx(share, abs=0.03)


def test_interval_by_cells_is_that_of_tokens(spark):
    r = random.Random(9)
    rows = [("de", k, 0.2 * r.randrange(6)) for k in range(600)]
    scored = spark.createDataFrame([(str(k), lang, "a", k, min(1.0, max(0.0, round(g + 0.2 * r.randrange(-2, 3), 1))), g) for lang, k, g in rows], "pair_id string, lang string, side string, k int, pred double, gold double")
    got = resample.token_interval(scored, 800).first()
    x, y = (np.array([q[c] for q in scored.select("pred", "gold").collect()]) for c in ("pred", "gold"))
    rng, rhos = np.random.default_rng(1), []
    for _ in range(400):
        w = rng.poisson(1.0, len(x))
        a, b = np.repeat(x, w), np.repeat(y, w)
        ranks = lambda v: np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right")
        rhos.append(np.corrcoef(ranks(a), ranks(b))[0, 1])
    lo, hi = np.percentile(rhos, [2.5, 97.5])
    assert got["lo"] == pytest.approx(lo, abs=0.02) and got["hi"] == pytest.approx(hi, abs=0.02)


WORDS = ["the", "and", "energy", "energie", "énergie", "water", "eau", "wasser", "12", "7%", "3,5", "lake", "See", "policy", "politik", "the", "in", "im"]


def some_pairs(spark, seed=3, n=12):
    r = random.Random(seed)
    text = lambda: "".join(" ".join(r.choices(WORDS, k=r.randint(1, 9))) + r.choice([" . ", "! ", ".\n", " ? "]) for _ in range(r.randint(0, 9)))
    rows = [(f"p{k}", "de", text(), text()) for k in range(n)] + [("none", "de", "", ""), ("one", "de", "a! b!", ""), ("other", "de", "", "a! b!"), ("signs", "de", ". ! ?\n! . ", "; : .\n! ")]
    return spark.createDataFrame(rows, "pair_id string, lang string, text_a string, text_b string")


@pytest.mark.parametrize("stretch", [1, 40, 1 << 20])
def test_cells_by_pair_are_the_cells_by_join(spark, monkeypatch, stretch):
    monkeypatch.setattr(similarity, "STRETCH", stretch)
    monkeypatch.setattr(similarity, "PAIRS", 3)
    segments = segment.segments(segment.tokens(pairs.sides(some_pairs(spark))))
    want = similarity.scored(similarity.candidates(similarity.sizes(segments)), segments)
    columns = ["pair_id", "n", "m", "i", "j", "lexical", "score", "sim"]
    rows = lambda d: Counter(map(tuple, d.select(*columns).collect()))
    got = similarity.matrix(segments)
    assert rows(similarity.cells(got)) == rows(want) and want.count() > 100
    ops = lambda d: Counter(map(tuple, d.collect()))
    assert ops(align.operations_of(got)) == ops(align.operations(similarity.sizes(segments), want))


def test_spans_are_placed_as_offsets_say(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["ab", "b", "abb", " ", "  ", "\n", "."]) for _ in range(r.randint(1, 40))) for _ in range(40)]
    sides = spark.createDataFrame([(str(k), "a", t) for k, t in enumerate(texts)], "pair_id string, side string, text string")
    found = lambda t: [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
    rows, want = [], Counter()
    for k, t in enumerate(texts):
        spots = found(t)
        if not spots:
            continue
        for op in range(6):
            lo = r.randrange(len(spots))
            begin = r.randrange(len(t))
            span = t[begin : begin + r.randint(1, 6)] if r.random() < 0.8 else "zz"
            rows.append((str(k), op, [span], None, lo, len(spots), spots[lo][0], 0, 0, 0))
            at = t.find(span, spots[lo][0])
            at = t.find(span) if at < 0 else at
            hit = [i for i, (s, e) in enumerate(spots) if s < at + len(span) and e > at] if at >= 0 else []
            want[str(k), op, span, at if at >= 0 else None, tuple(hit)] += 1
    schema = "pair_id string, op_idx int, spans_a array<string>, spans_b array<string>, tok_lo_a int, tok_hi_a int, char_lo_a int, tok_lo_b int, tok_hi_b int, char_lo_b int"
    got = score.span_places(spark.createDataFrame(rows, schema), sides).collect()
    assert Counter((x.pair_id, x.op_idx, x.span, x.pos, tuple(range(x.lo, x.hi)) if x.pos is not None else ()) for x in got) == want


def test_tokens_are_not_shuffled_after_texts_are_dealt(spark):
    """One exchange for the texts, none for tokens, segments, baseline labels."""
    d = some_pairs(spark)
    for of in (lambda t: t, segment.segments, baseline.labels):
        plan = of(segment.tokens(pairs.sides(d)))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange (?!SinglePartition)", plan)) == 1, plan


def test_batches_come_back_to_their_cells(spark):
    segments = segment.segments(segment.tokens(pairs.sides(some_pairs(spark, n=5))))
    requests = batched.similarity_requests(segments, "m", 7)
    rows = requests.collect()
    assert all(len(x.cells) <= 7 for x in rows) and {x.pair_id for x in rows if x.key is None} >= {"one", "other"}
    wanted = {(x.pair_id, x.i, x.j) for x in similarity.candidates(similarity.sizes(segments)).collect()}
    assert Counter((x.pair_id, c.i, c.j) for x in rows for c in x.cells) == Counter(wanted)
    # a reply with a score for the first cell, a wrong place, and one score too high
    answers = spark.createDataFrame([(x.key, 'scores: {"scores": [{"i": %d, "j": %d, "score": 2.5}, {"i": 99, "j": 0, "score": 5}, {"i": %d, "j": %d, "score": 9}]}' % (*x.cells[0], *x.cells[-1])) for x in rows if x.key], "key string, text string")
    matrix, missing = batched.similarity_matrix(requests, answers.dropDuplicates(["key"]))
    got = {(x.pair_id, x.i, x.j): x.sim for x in similarity.cells(matrix).collect()}
    assert missing == sum(max(0, len(x.cells) - 2) for x in rows) and set(got) == wanted and matrix.count() == len({x.pair_id for x in rows})
    for x in rows:
        for k, c in enumerate(x.cells):
            assert got[x.pair_id, c.i, c.j] == (1.0 if k == len(x.cells) - 1 else 0.5 if not k else 0.0)
    first = model.request_of(F.col("prompt"))
    told = requests.filter("key is not null").select(F.from_json(first, "kind string, pairs array<struct<i:int,j:int,a:string,b:string>>").alias("r"), "cells").first()
    assert told.r.kind == "similarity" and [(c.i, c.j) for c in told.r.pairs] == [tuple(c) for c in told.cells]


def test_judgments_from_replies(spark):
    d = some_pairs(spark, n=4)
    segments = segment.segments(segment.tokens(pairs.sides(d)))
    ops = align.operations_of(similarity.matrix(segments))
    requests = batched.judge_requests(ops, segments, "m").cache()
    rows = requests.collect()
    word = lambda t: t.split()[0]
    replies = {x.key: ['{"semantic_difference": 4, "differing_spans": {"side_a": ["%s", "not there"], "side_b": ["%s", "%s"]}}' % (word(x.text_a), word(x.text_b), x.text_b.split()[-1]), "no idea"][k % 2] for k, x in enumerate(rows)}
    state = waves.replay(requests.select("key", "prompt").dropDuplicates(["key"]), spark.createDataFrame(list(replies.items()), "key string, text string")).state
    for x in batched.judgments(requests, state).collect():
        if replies[x.key] == "no idea":
            assert x.difference is None and not x.ok and x.spans_a == x.spans_b == []
        else:
            assert x.difference == 4 and x.ok and x.spans_a == [word(x.text_a)] and len(x.spans_b) == 2


def test_baseline_from_replies(spark):
    d = spark.createDataFrame([("p", "de", "a b . c", "x y"), ("q", "de", "a b", "x"), ("r", "de", None, "x")], "pair_id string, lang string, text_a string, text_b string")
    requests = baseline.requests(d, "m").cache()
    keys = {r.pair_id: (r.key, r.prompt) for r in requests.collect()}
    whole = '{"sentence1": [["a", 5], ["b", 0], [".", -1], ["c", 3]], "sentence2": [["x", 1], ["y", 4]]}'
    broken = '{"sentence1": [["a", 2], ["b", 1'
    answers = spark.createDataFrame([(keys["p"][0], whole), (keys["q"][0], broken)], "key string, text string")
    got = {r.pair_id: r for r in baseline.replied(requests, answers).collect()}
    close = lambda x: pytest.approx(x)
    assert got["p"].labels_a == close([0.0, 1.0, -1.0, 0.4]) and got["p"].labels_b == close([0.8, 0.2])
    assert got["q"].labels_a == close([0.6, 0.0]) and got["q"].labels_b == close([0.0]) and not got["r"].answered and got["r"].labels_b == [0.0]
    assert baseline.complete(whole, keys["p"][1]) and not baseline.complete(broken, keys["q"][1]) and not baseline.complete("?", keys["p"][1])



def test_ranges_by_number_are_those_by_expression(spark):
    """Cuts go to tasks once; as columns their arrays were copied into every row, so work grew with rows times ranges."""
    nan = float("nan")
    known = [{"x": np.array([-1.0, 0.0, 0.5, 2.0])}, {"x": np.array([0.25, nan])}, {"x": np.array([])}]
    values = [None, nan, -math.inf, math.inf, -2.0, -1.0, -0.0, 0.0, 0.1, 0.25, 0.5, 2.0, 3.0]
    rows = [(g, v, known[g]["x"].tolist()) for g in range(3) for v in values]
    d = spark.createDataFrame(rows, "g int, x double, cuts array<double>").repartition(3)
    both = d.select("g", "x", continuous.ranges_of({"x": F.col("x")}, F.col("g"), known)["x"].alias("a"), continuous.range_of(F.col("x"), F.col("cuts"), 5).alias("b")).collect()
    assert len(both) == len(rows) and all(r.a == r.b for r in both), both


def test_a_table_that_is_read_often_is_made_once(spark, monkeypatch):
    from plumbline.operators import report

    made = []
    monkeypatch.setattr(report, "stored", lambda d, name: made.append(name) or d)
    gold = spark.createDataFrame([(k, "de", [0.2 * (k % 3), 0.4], [1.0, -1.0]) for k in range(6)], "pair_id long, lang string, labels_a array<double>, labels_b array<double>")
    first = gold.withColumn("system", F.lit("s"))
    assert [tuple(r) for r in report.compare_systems(first, gold).collect()] == [("s", "de", 1.0, 1.0, 1.0)]
    assert made == ["systems", "gold", "cells"]
    assert {(r.method, r.n_matched) for r in report.matched(gold, gold.filter("pair_id > 1"), gold).collect()} == {("first", 4), ("second", 4)}


def test_no_row_holds_all_cells_of_a_pair(spark, monkeypatch):
    """Cells and calls leave a pair's row in batches, with the cells and the order of the whole."""
    monkeypatch.setattr(similarity, "BATCH", 8)
    text = lambda word: ". ".join(f"{word}{k} energy {k}" for k in range(40)) + ". "
    d = some_pairs(spark, n=4).unionByName(spark.createDataFrame([("long", "de", text("a"), text("b"))], "pair_id string, lang string, text_a string, text_b string"))
    segments = segment.segments_of(pairs.sides(d))
    whole = list(similarity.in_rows(iter([(0, 40, 40, similarity.band_stretches(40, 40, 0.2, 2))]), 3, lambda row, cells: list(cells)))
    assert len(whole) > 20 and all(ends[-1].as_py() <= 16 for _, ends, _ in whole) and sum(ends[-1].as_py() for _, ends, _ in whole) == len(similarity.band_of_row(np.arange(40), 40, 40, 0.2, 2)[0])
    monkeypatch.undo()
    want = similarity.cells(similarity.matrix(segments))
    rows = lambda d: Counter(map(tuple, d.select("pair_id", "lang", "n", "m", "i", "j", "lexical", "score", "sim").collect()))
    assert rows(similarity.cells_of(segments)) == rows(want) == rows(similarity.scored(similarity.candidates(similarity.sizes(segments)), segments))
    parts = similarity.parts(segments, 7).select("pair_id", "part", "cells").collect()
    calls = {(x.pair_id, x.batch): [tuple(c) for c in x.cells] for x in batched.similarity_requests(segments, "m", 7).collect() if x.key}
    assert {(x.pair_id, x.part): [(c.i, c.j) for c in x.cells] for x in parts} == calls and max(map(len, calls.values())) == 7


def test_operations_straight_from_segments(spark, monkeypatch):
    """As by way of the matrix, however pairs are grouped."""
    segments = segment.segments_of(pairs.sides(some_pairs(spark, n=30)))
    rows = lambda d: Counter(map(tuple, d.collect()))
    want = rows(align.operations_of(similarity.matrix(segments, 3)))
    for cells in (1, 100, align.GROUP_CELLS):
        monkeypatch.setattr(align, "GROUP_CELLS", cells)
        assert rows(align.operations_from(segments, 3)) == want and len(want) > 50


def test_scores_outside_of_spark_are_rounded_alike(spark):
    lexical = np.r_[np.random.default_rng(1).random(2000), [0.03, 0.05, 0.07, 0.09, 0.11, 0.25]]
    hashes = np.r_[np.random.default_rng(2).integers(0, 1 << 32, 2000), np.full(6, 2147483648)]
    d = spark.createDataFrame([(k, float(x), int(h)) for k, (x, h) in enumerate(zip(lexical, hashes, strict=True))], "k int, lexical double, hash long")
    want = [(x.s, x.sim) for x in d.withColumn("s", similarity._score(F.col)).withColumn("sim", T.clamp01(F.col("s") / 5)).orderBy("k").collect()]
    assert list(zip(*map(np.ndarray.tolist, similarity.exact_scores(lexical, hashes)), strict=True)) == want


def test_sums_so_far_go_on_over_batches(spark):
    """Ranks are summed in the order of the sort; values are dealt once for them, after they are counted."""
    r = random.Random(5)
    rows = [(r.choice(["de", "fr"]), r.choice([r.random(), 0.5]), r.randint(1, 3)) for _ in range(300)]
    d = spark.createDataFrame(rows, "lang string, pred double, w long").coalesce(1).sortWithinPartitions("lang", "pred")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = continuous.so_far(d, ["lang"], "w").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sums = Counter()
    for x in got:
        assert x.before == sums[x.lang]
        sums[x.lang] += x.w
    assert len(got) == 300


def test_few_gold_labels_take_one_sort(spark, monkeypatch):
    """Ranks and inversions from one pass, whatever the chunks, ties and repeated rows; many gold labels go the general way."""
    monkeypatch.setattr(continuous, "CHUNK", 1)
    r = random.Random(7)
    rows = [("a", r.random(), r.randrange(6) / 5) for _ in range(500)] + [("b", r.randrange(5) / 4, r.randrange(3) / 2) for _ in range(400)]
    rows += [("c", 1.0, r.randrange(3) / 2) for _ in range(30)] + [("d", 0.1, 0.2), ("d", None, 0.4)] + [("e", 0.5 if r.random() < 0.5 else r.random(), 0.0) for _ in range(50)]
    few = spark.createDataFrame(rows, "lang string, pred double, gold double").repartition(5).withColumn("w", F.lit(1))
    many = spark.createDataFrame(some_rows(3), "lang string, pred double, gold double").withColumn("w", F.lit(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [{x["lang"]: x for x in continuous.correlations(d, "lang").collect()} for d in (few, many)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for found, given in zip(got, (rows, some_rows(3)), strict=True):
        for lang in "abcde":
            n, rho, tau = brute([x for x in given if x[0] == lang and x[1] is not None])
            assert found[lang]["n"] == n
            assert found[lang]["spearman"] == (None if rho is None else pytest.approx(rho, abs=1e-9)), lang
            assert found[lang]["kendall"] == (None if tau is None else pytest.approx(tau, abs=1e-12)), lang
    assert continuous.correlations(few.filter("false"), "lang").collect() == []


def test_scores_of_a_pair_are_those_of_its_tokens(spark):
    """Numbers made in the pair's row are the expressions' own, bit for bit, and no token is a row before."""
    df = spark.createDataFrame([(1, "de", "One two . three - x", "Eins , zwei"), (22, "fr", "", "Un"), (3, "it", None, "!")], "pair_id long, lang string, text_a string, text_b string")
    t = segment.words(pairs.sides(df)).withColumn("gold", baseline.gold_label()).filter("gold >= 0")
    noise = resample.uniform(F.lit("score"), F.col("pair_id").cast("string"), F.col("side"), F.col("idx").cast("string"))
    want = t.select("lang", (F.col("gold") / 4 + noise).alias("pred"), "gold").collect()
    got = baseline.scores_of(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
