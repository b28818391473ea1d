"""Vector joins, periodic runs and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import grid_join, periods, spelling
from plumbline.llm.queries import _planted_run

# --- vectors ---------------------------------------------------------------------------------------------------------


def valid(label, e):
    return label is not None and bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)


def joined(rows, cosine):
    """Every pair of a label, one after the other."""
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, li, a) in enumerate(rows):
        for j, (_, lj, b) in enumerate(rows[:i]):
            if valid(li, a) and valid(lj, b) and li == lj and len(a) == len(b):
                x, y = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    low = {}
    for k, (v, _, _) in enumerate(rows):
        if v is not None:
            low[root(k)] = min(low.get(root(k), v), v)
    return Counter((v, links[k], low.get(root(k)), v is not None and v == low.get(root(k))) for k, (v, _, _) in enumerate(rows))


SCHEMA = "vec_id long, label int, embedding array<float>, id long, unit string, block int, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "u", 2, "c") for r in rows], SCHEMA).repartition(3)


def clouds(seed, n, clouds, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clouds, d))
    spread = r.choice([0.0, 0.02, 0.1, 0.25], size=n)
    return [(k, int(r.integers(0, 2)) if k % 40 else None, (centres[r.integers(clouds)] + spread[k] * r.normal(size=d)).astype(np.float32).tolist()) for k in range(n)]


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK_BYTES", 1 << 11)  # some twenty vectors a block: several levels of intervals
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rows = clouds(5, 500, 25)
    rows += [(9000, 1, None), (9001, 1, []), (9002, 1, [0.0] * 12), (9003, 1, [float("nan")] * 12), (9004, 1, [None] + [1.0] * 11), (9005, 0, [float("inf")] + [1.0] * 11)]
    rows += [(None, 1, rows[1][2]), (None, 0, [1.0, 2.0]), (7, 0, [2.0, 4.0]), (7, 0, [2.0, 4.0]), (9007, 1, [1e-38] + [0.0] * 11), (9008, 1, [3e38] + [0.0] * 11), (9009, None, rows[1][2])]
    got = Counter(map(tuple, grid_join.near_duplicates(vectors(spark, rows), 0.93).collect()))
    assert got == joined(rows, 0.93)


def test_blocks_that_are_near_as_a_whole_are_counted_without_comparing(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK_BYTES", 1 << 10)
    monkeypatch.setattr(grid_join, "compare_blocks", None)  # must not be needed
    r = np.random.default_rng(1)
    rows = [(k, 3, (np.r_[5.0, np.zeros(7)] + 0.02 * r.normal(size=8)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(1000 + k, 3, rows[0][2]) for k in range(40)]
    got = grid_join.near_duplicates(vectors(spark, rows), 0.93).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(189, 0)} and sum(x.kept for x in got) == 1


def test_distant_intervals_are_skipped(spark):
    """Two far groups of a label: no pair of blocks goes across."""
    rows = [(k, 0, [1.0, 0.001 * k, 0.0]) for k in range(60)] + [(100 + k, 0, [-1.0, 0.001 * k, 0.0]) for k in range(60)]
    d = spark.createDataFrame([(v, lab, bytes(u), 1) for (v, lab, _), u in zip(rows, grid_join.unit_vectors(__import__("pyarrow").array([e for _, _, e in rows])), strict=True)], "id long, label int, unit binary, copies long")
    eps = float(np.sqrt(2 - 2 * 0.93))
    import unittest.mock as m

    with m.patch.object(grid_join, "BLOCK_BYTES", 24 * 20):
        axes = {3: grid_join.principal_axes(d, 3)}
        blocks = grid_join.store(grid_join.blocks_in_order(d, axes, eps), "test-blocks")
    side = {b.block: b.centre[0] > 0 for b in blocks.collect()}
    pairs = grid_join.near_blocks(blocks, eps).collect()
    assert len(side) >= 6 and {side[p.a] == side[p.b] for p in pairs} == {True}
    assert {(p.a, p.b) for p in pairs} >= {(b, b) for b in side}


def test_join_of_an_empty_table(spark):
    assert grid_join.near_duplicates(vectors(spark, clouds(1, 3, 1)).filter("false"), 0.9).collect() == []
    assert Counter(map(tuple, grid_join.near_duplicates(vectors(spark, [(1, None, None), (2, 1, [])]), 0.9).collect())) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


# --- periodic runs ---------------------------------------------------------------------------------------------------


def all_runs(w, min_length=24, min_exponent=3):
    found = {}
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_exponent * p):
                found.setdefault((i, j + p - i), p)  # the smallest period of the stretch comes first
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def random_words(r):
    out = []
    for _ in range(r.randint(0, 7)):
        kinds = r.choice([1, 2, 5, 60])
        if r.random() < 0.6:
            out += ([r.randint(0, kinds) for _ in range(r.randint(1, 12))] * r.randint(1, 40))[: r.randint(1, 160)]
        else:
            out += [r.randint(0, kinds) for _ in range(r.randint(0, 60))]
    return out


@pytest.mark.parametrize("probes", [1, 64, 1 << 18])
def test_runs_equal_brute_force(monkeypatch, probes):
    monkeypatch.setattr(periods, "PROBES", probes)
    r = random.Random(probes)
    for _ in range(300):
        w = random_words(r)
        assert periods.find_runs(np.array(w, np.int64)) == all_runs(w)
        assert periods.find_runs(np.array(w, np.int64), 7, 4) == all_runs(w, 7, 4)


def test_long_texts_of_runs_only():
    assert periods.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert len(periods.find_runs(np.repeat(np.arange(5000), 25))) == 5000
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(9, np.int64), 3, 2)


def test_periodic_runs_of_documents(spark, awkward, empty):
    def want(doc_id, text):
        words = _planted_run(doc_id, (text or "").encode().split())
        runs = all_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        return doc_id, len(words), tuple(runs), best, " ".join(x.decode() for k, x in enumerate(words) if k not in gone)

    loops = spark.createDataFrame([(100 + k, "so it goes, " * (k + 4) + "and " * 30 + "ends") for k in range(30)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text", "block").filter("n_chars = 1").unionByName(loops, allowMissingColumns=True)
    got = Counter((x.doc_id, x.n_words, tuple(map(tuple, x.runs)), x.strongest and tuple(x.strongest), x.collapsed) for x in periods.periodic_runs(docs, rewrite=_planted_run).collect())
    assert got == Counter(want(x.doc_id, x.text) for x in docs.collect()) and sum(len(k[2]) for k in got) > 30
    assert periods.periodic_runs(empty).collect() == []


def test_the_planted_run_is_the_one_asked_for():
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    assert ids and _planted_run(None, [b"a"]) == [b"a"] and _planted_run(ids[0], []) == []
    words = [str(k).encode() for k in range(100)]
    g = zlib.crc32(str(ids[0]).encode()) // 10
    a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
    assert _planted_run(ids[0], words) == words[:a] + [words[a + (i - a) % p] for i in range(a, 100)]


def test_runs_are_described_by_line(spark):
    d = spark.createDataFrame([([(0, 24, 1), (30, 90, 7)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    assert [x[0] for x in d.select(periods.describe(F.col("runs"))).collect()] == ["0,24,1\n30,90,7\n", ""]


# --- spelling --------------------------------------------------------------------------------------------------------


def variants(counts, ratio=2):
    """(word, form, root, n, n_near, form_n) from every pair of words."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= ratio * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(close[w]), counts.get(form.get(w))) for w, n in counts.items()}


def counted(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def test_variants_equal_all_pairs(spark):
    r = random.Random(4)
    words = {"".join(r.choices("abÿ", k=r.randint(1, 6))) for _ in range(400)}
    counts = {w: r.choice([1, 2, 3, 4, 8, 9, 16, 40, 100]) for w in words}
    counts["b" * 40], counts["b" * 39 + "a"], counts["b" * 39], counts["b" * 32], counts["b" * 33] = 5, 11, 30, 70, 1  # around and past the longest plain key
    counts |= {"z" * 3000: 4, "z" * 2999: 9, "z" * 1500 + "y" + "z" * 1499: 2}
    got = [tuple(x) for x in spelling.group_variants(counted(spark, counts)).collect()]
    want = variants(counts)
    assert len(got) == len(want) and set(got) == want and any(form and root != form for _, form, root, *_ in want)


def test_chains_are_followed_to_their_end(spark):
    """Words that differ in a place more each, each twice as frequent: one root."""
    words = ["a" * (12 - k) + "b" * k for k in range(12)]
    counts = {w: 2**k for k, w in enumerate(words)}
    assert {x.root for x in spelling.group_variants(counted(spark, counts)).collect()} == {words[-1]}


def test_words_are_counted_over_whole_texts(spark, awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    trans = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want, edited = Counter(), defaultdict(int)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(trans)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                edited[run] += 1
            want[run] += 1
    got = spelling.word_counts(awkward, word=spelling.edited_word(F.col("doc_id"), 3), min_chars=4, min_count=2).collect()
    assert {x.word: x.n for x in got} == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2} and edited
    assert spelling.group_variants(spelling.word_counts(empty)).collect() == []
