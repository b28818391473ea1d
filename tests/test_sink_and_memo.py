"""All or nothing on writing; each key asked for once, across restarts."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import model, waves
from plumbline.sources import run_sink
from plumbline.streaming import memo

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test

SCHEMA = "id string, labels array<double>, stats struct<n:int,ops:map<string,int>>"


@pytest.fixture(scope="module")
def records(spark):
    run_sink.register(spark)
    rows = [(f"i{k}", [0.5, -1.0] if k % 3 else None, (k, {"1:1": k})) for k in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def read(spark, path, **options):
    return spark.read.format("run_records").schema(SCHEMA).options(path=str(path), **options).load()


def test_records_come_back(spark, records, tmp_path):
    records.write.format("run_records").mode("append").save(str(tmp_path))
    records.limit(3).write.format("run_records").mode("append").option("partial", "true").save(str(tmp_path))
    assert sorted(map(str, read(spark, tmp_path).collect())) == sorted(map(str, records.collect()))
    assert read(spark, tmp_path, partial="true").count() == 3
    with pytest.raises(Exception, match="append"):
        records.write.format("run_records").mode("overwrite").save(str(tmp_path))


def test_a_job_that_fails_leaves_nothing_to_see(spark, records, tmp_path):
    records.write.format("run_records").mode("append").save(str(tmp_path))
    bad = records.withColumn("id", F.when(F.col("id") == "i7", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        bad.write.format("run_records").mode("append").save(str(tmp_path))
    assert read(spark, tmp_path).count() == 40
    (Path(tmp_path) / "data" / "left-by-a-killed-task.jsonl").write_text('{"id": "ghost"}\n')
    assert read(spark, tmp_path).count() == 40 and run_sink.sweep(str(tmp_path)) >= 1 and read(spark, tmp_path).count() == 40


def test_nothing_written_is_no_rows(spark, records, tmp_path):
    assert read(spark, tmp_path).count() == 0
    records.filter("false").write.format("run_records").mode("append").save(str(tmp_path))
    assert read(spark, tmp_path).count() == 0


def test_a_script_is_read(spark, records, tmp_path):
    path = tmp_path / "e.js"
    path.write_text('window.EVIDENCE = {"run": null, "items": [{"id": "a}{", "labels": [1], "stats": {"n": 2, "ops": {"1:1": 3}}}, {"id": null}]};\n')
    got = spark.read.format("evidence_script").schema(SCHEMA).load(str(path)).collect()
    assert [r.id for r in got] == ["a}{", None] and got[0].labels == [1.0] and got[0].stats.ops == {"1:1": 3} and got[1].stats is None


class Counting:
    """Answers in capitals; leaves a file for each call."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, messages, max_tokens, temperature, seed):
        import uuid

        prompt = messages[0]["content"]
        (Path(self.folder) / f"{prompt}-{uuid.uuid4().hex}").touch()
        if prompt == "bad":
            raise model.Unavailable("gone", passing=False)
        return model.estimated(model.Reply(prompt.upper()), prompt)


def test_each_key_is_asked_for_once_across_batches_and_restarts(spark, tmp_path):
    calls, source, out = tmp_path / "calls", tmp_path / "in", str(tmp_path / "out")
    calls.mkdir()
    schema = "ts timestamp, key string, prompt string"
    folder = str(calls)

    def arrive(*prompts):
        rows = spark.createDataFrame([(f"k-{p}", p) for p in prompts], "key string, prompt string").withColumn("ts", F.current_timestamp())
        rows.select("ts", "key", "prompt").coalesce(1).write.mode("append").parquet(str(source))

    def go(ask):
        stream = spark.readStream.schema(schema).parquet(str(source))
        memo.answer_once(stream, ask, out, str(tmp_path / "checkpoint")).awaitTermination()

    ask = lambda missing: waves.run(missing, lambda: Counting(folder), sleep=lambda s: None)
    arrive("a", "b", "a")
    go(ask)
    arrive("b", "c", "c")
    go(ask)  # a restart: new query, same checkpoint
    asked = lambda: sorted(p.name.split("-")[0] for p in calls.iterdir())
    assert asked() == ["a", "b", "c"]

    def crash(missing):
        ask(missing).state.count()
        raise RuntimeError("lost")

    arrive("d", "bad")
    with pytest.raises(Exception, match="lost"):
        go(crash)  # asked, but not written: the batch is tried again
    go(ask)
    before = asked()
    go(ask)
    assert asked() == before and before.count("d") == 2 and before.count("a") == before.count("b") == before.count("c") == 1
    got = memo.answered(spark.createDataFrame([("k-a",), ("k-c",), ("k-bad",), ("k-x",)], "key string"), out).collect()
    assert {r.key: r.text for r in got} == {"k-a": "A", "k-c": "C", "k-bad": None, "k-x": None}
