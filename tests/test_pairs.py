import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import evaluate, pairs


def test_places_do_not_depend_on_the_partitions(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaaab"), rng.random() < 0.7, i) for i in rng.sample(range(10**9), 3000)]
    df = spark.createDataFrame(rows, "source string, english boolean, doc_id long").repartition(5)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("source", "english").orderBy("doc_id")))
    got = pairs.ranked(df, ["source", "english"], "doc_id").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_of_nothing(spark):
    df = spark.createDataFrame([], "source string, english boolean, doc_id long")
    assert pairs.ranked(df, ["source", "english"], "doc_id").count() == 0


def test_kendall_of_pairs_of_tokens(spark):
    rng = random.Random(3)
    x = [(rng.randrange(40) / 7, rng.randrange(4) / 5) for _ in range(200)]
    sign = lambda v: (v > 0) - (v < 0)
    two = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for i, a in enumerate(x) for b in x[:i]]
    want = sum(p * g for p, g in two) / (sum(p * p for p, _ in two) * sum(g * g for _, g in two)) ** 0.5
    cells = evaluate.table(spark.createDataFrame(x, "pred double, gold double"))
    assert abs(evaluate.kendall(cells).first()["kendall"] - want) < 1e-9
    flat = evaluate.table(spark.createDataFrame([(1.0, 0.2), (1.0, 0.4)], "pred double, gold double"))
    assert evaluate.kendall(flat).first()["kendall"] is None
