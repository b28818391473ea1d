import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import files
from plumbline.streaming import scoring

GOLD = {"id": "admin_de_1", "text_a": "a b", "text_b": "c", "labels_a": [0.0, 1.0], "labels_b": [-1.0]}


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_gold_is_checked(spark, tmp_path):
    assert files.read_gold(spark, lines(tmp_path / "g.jsonl", GOLD)).count() == 1
    with pytest.raises(Exception, match="differ"):
        files.read_gold(spark, lines(tmp_path / "bad.jsonl", GOLD | {"labels_a": [0.0]})).collect()


def test_strict_json_refuses_nan(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"v": 1.5}')
    (tmp_path / "nan.json").write_text('{"v": NaN}')
    assert files.strict_json(spark, str(tmp_path / "ok.json"), "v double").first()["v"] == 1.5
    with pytest.raises(Exception, match="MALFORMED"):
        files.strict_json(spark, str(tmp_path / "nan.json"), "v double").collect()


def test_cache_and_manifest(spark, tmp_path):
    row = lambda *k: spark.createDataFrame([(x, "t", "m", "b") for x in k], files.CACHE)
    files.put_cache(row("1", "2", "2"), str(tmp_path / "c"))
    files.put_cache(row("2", "3"), str(tmp_path / "c"))
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "c")).collect()) == ["1", "2", "3"]
    ids = files.id_manifest(row("b").withColumn("id", F.col("key")), row("a", "b").withColumn("id", F.col("key")))
    assert [r["id"] for r in ids.collect()] == ["a", "b"]


def test_files_and_export(spark, tmp_path):
    (tmp_path / "dev").mkdir()
    (tmp_path / "dev" / "test.jsonl").write_text("x")
    (tmp_path / "dev" / "train.jsonl").write_text("y")
    assert files.digests(spark, str(tmp_path / "dev")).count() == 2
    assert [r["path"].rsplit("/", 1)[-1] for r in files.held_out_files(spark, str(tmp_path / "dev")).collect()] == ["test.jsonl"]
    files.export_evidence(spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string"), str(tmp_path / "e.js"))
    text = (tmp_path / "e.js").read_text()
    assert json.loads(text.removeprefix("window.EVIDENCE = ").rstrip(";\n")) == {"a": 1, "b": None, "c": None}


def test_stream_scores_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.json", {"id": "1", "labels_a": [0.5], "labels_b": []}, {"id": "2", "labels_a": [], "labels_b": []})
    go = lambda: scoring.each_batch(scoring.predictions(spark, str(tmp_path / "in")), lambda df: df.select("id", F.size("labels_a").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    go()
    lines(tmp_path / "in" / "b.json", {"id": "3", "labels_a": [0.1, 0.2], "labels_b": []})
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "n").collect()) == [("1", 1), ("2", 0), ("3", 2)]
