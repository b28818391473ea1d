"""Caps, retries, repairs and rates, an attempt at a time."""

import json
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.operators import model, runs, waves

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test


class Moody:
    """Fails as often as the prompt's first digit says, is not understood at first where its second digit is odd, fails for good on x."""

    def complete(self, messages, max_tokens, temperature, seed):
        prompt = messages[0]["content"]
        if prompt.startswith("x"):
            raise model.Unavailable("gone", passing=False)
        if len(messages) == 1 and seed < int(prompt[0]):
            raise model.Unavailable("busy")
        text = "what?" if int(prompt[1]) % 2 and len(messages) == 1 else json.dumps({"said": prompt})
        return model.Reply(text, prompt_tokens=10, completion_tokens=2)


def understood(text, prompt):
    return text.startswith("{")


def asked(spark, n=200):
    return spark.createDataFrame([(f"k{k:04d}", "x" if k % 50 == 7 else f"{k % 4}{k % 3}-{k}") for k in range(n)], "key string, prompt string")


def need(prompt):
    return 1 if prompt == "x" else 1 + int(prompt[0]) + int(prompt[1]) % 2


def test_every_request_is_answered_in_as_many_waves_as_one_may_need(spark):
    slept, budget = [], runs.Budget(10_000, 1_000_000)
    requests = asked(spark)
    out = waves.run(requests, Moody, understood, budget, waves.Rules(retries=5), sleep=slept.append)
    rows = {r.key: r for r in out.state.collect()}
    prompts = {r.key: r.prompt for r in requests.collect()}
    assert len(rows) == 200 and not out.capped and len(out.waves) == 5 and slept == [1, 2, 4]
    assert {k: r.attempts for k, r in rows.items()} == {k: need(p) for k, p in prompts.items()}
    assert budget.requests == sum(map(need, prompts.values())) and budget.tokens == sum(r.tokens for r in rows.values())
    for k, r in rows.items():
        gone = prompts[k] == "x"
        assert r.status == ("failed" if gone else "answered") and (r.error == "gone" if gone else json.loads(r.text)["said"] == prompts[k])
        assert r.repairs == (0 if gone else int(prompts[k][1]) % 2)


def test_requests_that_fail_too_often_are_given_up(spark):
    out = waves.run(asked(spark), Moody, understood, rules=waves.Rules(retries=1), sleep=lambda s: None)
    assert {r.attempts for r in out.state.filter("error = 'busy'").collect()} == {2} and out.state.filter("status = 'waiting'").count() == 0


@pytest.mark.parametrize("cap", [1, 37, 200, 260])
def test_the_request_cap_holds_with_retries(spark, cap):
    budget = runs.Budget(cap, 1_000_000)
    out = waves.run(asked(spark), Moody, understood, budget, sleep=lambda s: None)
    rows = out.state.collect()
    assert out.capped and budget.requests == cap == sum(r.attempts for r in rows) and len(rows) == 200
    assert len(out.waves) <= 4 and all(w[1] <= cap for w in out.waves)
    first = sorted(r.key for r in rows if r.attempts)
    assert first == sorted(r.key for r in rows)[: min(cap, 200)]  # admitted in order


def test_the_token_cap_bears_what_attempts_may_cost(spark):
    requests, rules = asked(spark), waves.Rules(max_tokens=20, complaint="again")
    budget = runs.Budget(10_000, 600)
    out = waves.run(requests, Moody, understood, budget, rules, sleep=lambda s: None)
    assert out.capped and 600 - 60 <= budget.tokens <= 600
    assert out.state.filter("status = 'answered'").count() > 600 // 40  # what was reserved and not spent came back


def test_few_jobs_however_many_requests(spark):
    tracker = spark.sparkContext.statusTracker()
    requests = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit("00").alias("prompt"))
    spark.sparkContext.setJobGroup("waves", "waves")
    try:
        out = waves.run(requests, Moody, understood, runs.Budget(15_000, 1 << 40), sleep=lambda s: None)
        jobs = len(tracker.getJobIdsForGroup("waves"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.capped and len(out.waves) == 1 and jobs < 30


class Timed:
    def complete(self, messages, max_tokens, temperature, seed):
        import time

        return model.Reply(str(time.time()), prompt_tokens=1, completion_tokens=1)


def test_all_tasks_together_keep_the_rate(spark):
    requests = spark.range(40).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"))
    out = waves.run(requests, Timed, rules=waves.Rules(lanes=4, per_second=20.0))
    at = sorted(float(r.text) for r in out.state.collect())
    assert at[-1] - at[0] >= 39 / 20 * 0.8 and all(len([x for x in at if t <= x < t + 0.5]) <= 10 + 4 for t in at)
    with pytest.raises(ValueError):
        waves.run(requests, Timed, rules=waves.Rules(per_second=2.0))


def test_memory_and_equal_requests(spark):
    requests = spark.createDataFrame([(1, "a", "00"), (2, "b", "00b"), (3, "b", "00b"), (4, "c", "x")], "n long, key string, prompt string")
    cache = spark.createDataFrame([("a", "old", "m", "b")], "key string, text string, model string, backend string")
    found, new, out = waves.invoke(requests, cache, lambda missing: waves.run(missing, Moody, understood))
    got = {r.n: (r.text, r.cached, r.error) for r in found.collect()}
    assert got == {1: ("old", True, None), 2: ('{"said": "00b"}', False, None), 3: ('{"said": "00b"}', False, None), 4: (None, False, "gone")}
    assert [r.key for r in new.collect()] == ["b"] and out.waves[0][0] == 2


def test_no_requests(spark):
    out = waves.run(asked(spark).filter("false"), Moody, understood)
    assert out.state.count() == 0 and not out.capped and out.waves == []


def test_the_call_log_has_every_field(spark):
    from plumbline.sources import files

    requests = spark.createDataFrame([(1, "a", "00", "i1"), (2, "b", "00b", "i2"), (3, "b", "00b", "i3"), (4, "c", "x", "i4")], "n long, key string, prompt string, item_id string").withColumn("split", F.lit("dev/val"))
    cache = spark.createDataFrame([("a", "old", "m", "b")], "key string, text string, model string, backend string")
    found, _, out = waves.invoke(requests.select("n", "key", "prompt"), cache, lambda missing: waves.run(missing, Moody, understood))
    log = waves.call_log(requests, found, out.state, "r1", "judge")
    assert [c.split()[0] for c in files.CALL.split(", ")] == log.columns
    rows = {r.item_id: r for r in log.collect()}
    assert [rows[i].cached for i in ("i1", "i2", "i3", "i4")] == [True, False, True, False]
    assert rows["i2"].prompt_tokens == 10 and rows["i3"].prompt_tokens is None and rows["i4"].error == "gone" and not rows["i4"].ok and rows["i1"].ok


class Breaking:
    """Labels the first sentence only, and breaks off; all of it when asked again."""

    def complete(self, messages, max_tokens, temperature, seed):
        prompt = messages[0]["content"]
        asked = json.loads(prompt[prompt.rfind("<request>") + 9 : prompt.rfind("</request>")])
        first = json.dumps([[t, 5] for t in asked["sentence1"]])
        second = json.dumps([[t, 0] for t in asked["sentence2"]])
        text = f'{{"sentence1": {first}, "sent' if len(messages) == 1 else f'{{"sentence1": {first}, "sentence2": {second}}}'
        return model.Reply(text, prompt_tokens=1, completion_tokens=1)


def test_a_baseline_is_asked_again_until_it_is_complete(spark):
    from plumbline.operators import baseline

    d = spark.createDataFrame([("p", "de", "a b c", "x y z"), ("q", "de", "a", None)], "pair_id string, lang string, text_a string, text_b string")
    requests = baseline.requests(d, "m").cache()
    out = waves.run(requests.select("key", "prompt").dropDuplicates(["key"]), Breaking, baseline.complete, rules=waves.Rules(repairs=1))
    got = {r.pair_id: r for r in baseline.replied(requests, out.state).collect()}
    assert got["p"].labels_a == [0.0] * 3 and got["p"].labels_b == [1.0] * 3 and got["q"].labels_a == [0.0] and got["q"].labels_b == []
    assert sorted(r.repairs for r in out.state.collect()) == [0, 1]


def test_a_task_holds_few_prompts_at_a_time():
    """Long prompts by bytes, short ones by rows; all rows in order."""
    rows = [{"key": f"k{k}", "prompt": "x" * (100_000 if k % 2 else 10)} for k in range(300)]
    short = pa.RecordBatch.from_pylist([{"key": str(k), "prompt": ""} for k in range(1000)])
    for batch, most in ((pa.RecordBatch.from_pylist(rows), 50), (short, waves.PIECE_ROWS)):
        found = list(waves.pieces(iter([batch, batch])))
        assert max(b.num_rows for b in found) <= most and [x for b in found for x in b.column(0).to_pylist()] == 2 * batch.column(0).to_pylist()
