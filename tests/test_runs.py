import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import guard, lifecycle, model, report, runs
from plumbline.sources import files


class Flaky:
    """Fails a given number of times, then answers."""

    def __init__(self, failures, passing=True):
        self.failures, self.passing = failures, passing

    def complete(self, messages, max_tokens=0, temperature=0.0, seed=0):
        if self.failures:
            self.failures -= 1
            raise model.Unavailable("busy", self.passing)
        return model.Reply("ok")


def test_retries_wait_longer_each_time():
    slept = []
    patient = model.Patient(Flaky(6), retries=6, sleep=slept.append)
    assert patient.complete([]).text == "ok" and slept == [1, 2, 4, 8, 16, 30] and patient.attempts == 7
    for backend, attempts in ((Flaky(3), 3), (Flaky(1, passing=False), 1)):
        patient = model.Patient(backend, retries=2, sleep=slept.append)
        with pytest.raises(model.Unavailable):
            patient.complete([])
        assert patient.attempts == attempts


def test_throttle():
    now, slept = [0.0], []
    patient = model.Patient(Flaky(0), per_second=4, sleep=slept.append, clock=lambda: now[0])
    patient.complete([])
    now[0] = 0.1
    patient.complete([])
    assert slept == [pytest.approx(0.15)]


def test_memory_budget_and_failures(spark):
    requests = spark.createDataFrame([(1, "a", "pa"), (2, "b", "pb"), (3, "a", "pa"), (4, "c", None), (5, "d", "pd")], "n long, key string, prompt string")
    cache = spark.createDataFrame([("a", "old", "m", "b"), ("b", None, "m", "b")], files.CACHE)
    call = lambda r: model.answered(r, lambda: model.Replay({"pb": "new", "": "empty"}))
    found, new, capped = model.invoke(requests, cache, call)
    got = {r["n"]: (r["text"], r["cached"], r["error"]) for r in found.collect()}
    assert got == {1: ("old", True, None), 3: ("old", True, None), 2: ("new", False, None), 4: ("empty", False, None), 5: (None, False, "no reply is known")}
    assert not capped and {r["key"] for r in new.collect()} == {"b", "c"}
    found, _, capped = model.invoke(requests, cache, call, runs.Budget(max_requests=1))
    assert capped and found.filter("cached is null").select("key").distinct().count() == 2


def test_prompts_and_keys(spark):
    df = spark.createDataFrame([("fr", "a \"b\"", "c")], "lang string, a string, b string")
    row = df.select(model.judge_prompt(F.col("lang"), F.col("a"), F.col("b")).alias("p")).withColumn("r", model.request_of(F.col("p"))).first()
    assert "French" in row["p"] and json.loads(row["r"]) == {"kind": "judge", "side_a": 'a "b"', "side_b": "c"}
    keys = df.select(*[model.call_key(F.lit("m"), F.col("a"), F.lit(k)).alias(f"k{k}") for k in (0, 1)]).first()
    assert keys[0] != keys[1]
    whole = df.select(model.baseline_prompt(F.col("lang"), F.split("a", " "), F.split("b", " ")).alias("p")).first()["p"]
    assert 'a "b"' in whole and df.select(model.request_of(F.col("a")).alias("r")).first()["r"] is None


def test_run_settings(tmp_path):
    assert lifecycle.new_run(str(tmp_path)) != lifecycle.new_run(str(tmp_path))
    assert lifecycle.resolve_backend(None, None) == "mock" and lifecycle.resolve_backend(None, "hosted") == "hosted"
    for bad in (("mock", "hosted"), ("x", None)):
        with pytest.raises(lifecycle.Refused):
            lifecycle.resolve_backend(*bad)
    assert lifecycle.languages("all") == list(guard.LANGUAGES)
    with pytest.raises(guard.HeldOut):
        lifecycle.languages("xx")
    assert lifecycle.assert_dev_path("data/gold/dev/val.jsonl")
    with pytest.raises(guard.HeldOut):
        lifecycle.assert_dev_path("data/gold/full/all.jsonl")
    (tmp_path / "c.json").write_text('{"config": {"add_label": 0.7}}')
    assert lifecycle.load_config(None, str(tmp_path / "c.json"), {"add_label": 0.9}) == {"add_label": 0.7}
    assert lifecycle.load_config(None, str(tmp_path / "none"), {"add_label": 0.9}) == lifecycle.load_config({}, None, {"add_label": 0.9})
    with pytest.raises(lifecycle.Refused):
        lifecycle.load_config({"x": 1}, None, {"add_label": 0.9})
    assert lifecycle.source_state(str(tmp_path), "known") == {"commit": "known", "dirty": None}


def test_files_of_a_run(spark, tmp_path):
    df = spark.createDataFrame([("1", "m", "b", "de", [0.5], [0.1])], "id string, mode string, backend string, lang string, labels_a array<double>, labels_b array<double>").coalesce(1)
    files.write_predictions(df, str(tmp_path))
    place = f"{tmp_path}/predictions/mode=m/backend=b/lang=de"
    assert files.read_predictions(spark, place).first()["labels_a"] == [0.5]
    files.write_predictions(df, str(tmp_path))
    with pytest.raises(ValueError, match="several"):
        files.read_predictions(spark, place)
    files.write_details(lifecycle.failed(df, F.lit("x" * 400)), str(tmp_path))
    assert len(spark.read.json(f"{tmp_path}/details").first()["error"]) == 300
    (tmp_path / "ids.json").write_text('{"commit": "c", "ids": ["a", "b", "a"]}')
    assert lifecycle.load_manifest(spark, str(tmp_path / "ids.json")).count() == 2
    assert lifecycle.summary_json(spark.createDataFrame([("r", "m", "de", 1, None)], "run_id string, mode string, lang string, n int, x int")).first()["summary"] == '{"n":1}'


def test_gaps_end_an_evaluation_that_needs_all(spark):
    schema = "pair_id string, lang string, labels_a array<double>, labels_b array<double>"
    gold = spark.createDataFrame([("1", "de", [0.1, 0.9], [-1.0]), ("2", "de", [0.5], [0.6])], schema)
    pred = gold.filter("pair_id = '1'")
    with pytest.raises(report.Incomplete, match="de: 1 missing 2; it: none|it: none.*; de: 1"):
        report.evaluate(pred, gold, ["de", "it"], require_full=True)
    got = {r["lang"]: r for r in report.evaluate(pred, gold, ["de", "it"]).collect()}
    assert got["de"]["spearman"] == pytest.approx(1.0) and got["de"]["coverage"] == 0.5 and got["it"]["invalid_reason"] == "no predictions"
    with pytest.raises(report.Incomplete, match="s: 1 missing"):
        report.compare_systems(pred.withColumn("system", F.lit("s")), gold)
