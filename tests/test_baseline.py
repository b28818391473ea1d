"""Labels made in a pair's row, against the window over its tokens, a loop and SQL."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import cutting
from plumbline.operators import baseline, evaluate, pairs, report, segment
from plumbline.plans import catalogue

ODD = [
    ("cost $ $ x", "$ $"), ("", "a b"), (None, "x y"), ("a", ""), ("  ", " "), (None, None), ("one  two   three 12", "Two, 12 ٣٤ ... ONE!"), ("* +", "x * y"),
    ("ÉTÉ İz ΣΑΣ été.", "été σας i̇z !!"), ("a　b\x85c . ,;", "B - – c:"), ("same " * 40, "Same? " * 3),
]


def some_pairs(spark):
    r = random.Random(5)
    word = lambda: r.choice(["Haus", "haus.", "17", "...", "-", "$", "été", "No!", "x%d" % r.randrange(60)])
    more = [tuple(r.choice(" \n").join(word() for _ in range(r.randrange(80))) + r.choice(["", "  end"]) for _ in "ab") for _ in range(30)]
    rows = [(k, "de", *x) for k, x in enumerate(ODD + more)]
    return spark.createDataFrame(rows, "pair_id long, lang string, text_a string, text_b string")


def rows(d, *names):
    return Counter(tuple(r) for r in d.select(*names).collect())


@pytest.mark.parametrize("seed", [0, 3])
def test_labels_of_pairs_are_those_of_tokens(spark, seed):
    p = some_pairs(spark)
    names = ("pair_id", "lang", "side", "idx", "tok", "code", "label")
    want = baseline.labels(segment.words(pairs.sides(p)), seed)
    assert rows(baseline.labels_of(p, seed), *names) == rows(want, *names)
    told = [r for r in baseline.records_of(p, seed).collect() if r.labels_a or r.labels_b]
    assert {r.pair_id: r for r in told} == {r.pair_id: r for r in baseline.records(want).collect()}
    gold = [r for r in baseline.gold_of(p).collect() if r.labels_a or r.labels_b]
    assert {r.pair_id: r for r in gold} == {r.pair_id: r for r in baseline.records(baseline.gold(segment.words(pairs.sides(p)))).collect()}


def test_counts_are_those_of_aligned_labels(spark):
    p = some_pairs(spark).withColumn("read_a", F.lit(3)).withColumn("read_b", F.lit(50))
    first = lambda s, n: F.transform(f"labels_{s}", lambda x, k: F.when(k < n, x).otherwise(0.0)).alias(f"labels_{s}")
    read = baseline.records_of(p).select("pair_id", first("a", 3), first("b", 50))
    want = evaluate.aligned(baseline.gold_of(p), read).groupBy("pair_id", "lang", "side", "pred", "gold").count()
    names = ("pair_id", "lang", "side", "pred", "gold")
    got = baseline.counts_of(p).groupBy(*names).agg(F.sum("w").alias("w"))
    assert rows(got, *names, "w") == rows(want, *names, "count")
    tokens = baseline.labels_of(p).filter((F.col("side") == "a") & (F.length("tok") > 4)).count()
    assert baseline.counts_of(p, longer=4).filter("side = 'a' and long").agg(F.sum("w")).first()[0] == tokens


@pytest.mark.parametrize("block", [1, 200, 1 << 22])
def test_blocks_of_pairs(block, monkeypatch):
    texts = ODD * 3
    a, b = (pa.array([None, *[x[k] for x in texts]])[1:] for k in (0, 1))
    whole = baseline._tokens(a, b, 0).to_pylist()
    monkeypatch.setattr(cutting, "BLOCK", block)
    assert baseline._tokens(a, b, 0).to_pylist() == whole
    for s, x, text in (("a", 0, a), ("b", 1, b)):
        assert [[t["tok"] for t in row if t["side"] == s] for row in whole] == [[t["tok"] for t in row or ()] for row in cutting._blocks(text, cutting._tokens, pa.struct([("piece", pa.string()), ("tok", pa.string()), *[(k, pa.int32()) for k in ("start", "end", "seg")]])).to_pylist()]
    assert baseline._tokens(a[:0], b[:0], 0).to_pylist() == []


@pytest.fixture(scope="module")
def odd_tables(tmp_path_factory):
    """``ODD`` as documents of one source and their copies of another; a third of the pairs has no prediction, some are toxic."""
    place = tmp_path_factory.mktemp("odd")
    docs, labels = [], []
    for k, (a, b) in enumerate(x for x in ODD * 2 if None not in x and "Σ" not in x[0]):  # DuckDB has no final sigma
        docs += [(2 * k, a, "en", "s%d" % (k % 2), len(a)), (2 * k + 1, b, ("de", "fr")[k % 2], "s%d" % (k % 2), len(b))]
        if k % 3:
            labels.append((2 * k, 1, int(k % 5 == 0)))
    write = lambda name, rows, columns: pq.write_table(pa.table({c: list(x) for c, x in zip(columns, zip(*rows, strict=True), strict=True)}), place / f"{name}.parquet")
    write("documents", docs, ("doc_id", "text", "lang", "source", "n_chars"))
    write("labels", labels, ("doc_id", "quality", "toxic"))
    return place


@pytest.mark.parametrize("name", ["delta_labels", "pred_gold_join", "evaluate_report", "baseline_labels", "spearman_lang", "drop_id_eval"])
def test_odd_texts_as_in_sql(spark, odd_tables, name):
    value = lambda v: repr(round(float(v), 6) + 0.0) if isinstance(v, float) else repr(v)
    con = duckdb.connect()
    for f in odd_tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = Counter(tuple(map(value, r)) for r in found.fetchall())
    assert Counter(tuple(map(value, r)) for r in entry.queries()[name](spark, str(odd_tables)).select(*columns).collect()) == want


@pytest.mark.parametrize("of", [catalogue._evaluated, catalogue._predictions, catalogue._gold])
def test_labels_are_made_once_and_nothing_is_sorted_for_them(spark, of):
    plan = of(spark, "/root/testdata/sf0.001").groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" not in plan and "norm" not in plan
    plan = of(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_report_counts_items_without_gold_labels(spark):
    """Pairs without predictions need no gold labels; missing and short predictions count as 0."""
    names = "pair_id long, labels_a array<double>, labels_b array<double>"
    gold = spark.createDataFrame([(1, [0.0, 1.0, 0.5], [-1.0]), (2, [0.2], [0.4, -1.0])], names).withColumn("lang", F.lit("de"))
    said = spark.createDataFrame([(1, [0.3, None], [1.0, 1.0]), (2, [0.5, 0.5], None), (9, [1.0], [1.0])], names)
    items = spark.createDataFrame([(1, "de"), (2, "de"), (3, "de"), (4, "fr")], "pair_id long, lang string")
    drop = spark.createDataFrame([(2,)], "pair_id long")
    got = {(r.variant, r.lang): tuple(r)[2:9] for r in report.evaluate(said, gold, ["de", "fr"], drop, items=items).collect()}
    assert got["all", "de"] == (3, 2, 6, 2, 0, 0.666667, 1) and got["excluding", "de"] == (2, 1, 3, 1, 0, 0.5, 1) and got["all", "fr"] == (1, 0, 0, 0, 0, 0.0, 1)
