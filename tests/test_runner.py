"""A run as one call: files, failures, slices, export."""

import json

import pytest

from plumbline.operators import lifecycle, report, runner, score
from plumbline.sources import files

SCHEMA = "id string, lang string, text_a string, text_b string, labels_a array<double>, labels_b array<double>"
TEXTS = {
    "d1": ("de", "Water policy . Switzerland protects its lakes .", "Wasserpolitik . Die Schweiz schützt ihre Seen ."),
    "d2": ("de", "One line only", "Nur eine Zeile hier"),
    "d3": ("de", "No other side .", None),
    "f1": ("fr", "Energy is dear .\nNobody minds .", "L' énergie est chère .\nPersonne ne s' en soucie ."),
}


@pytest.fixture(scope="module")
def gold(spark):
    label = lambda t: [] if t is None else [-1.0 if w == "." else (k % 3) / 2 for k, w in enumerate(t.split())]
    return spark.createDataFrame([(i, lang, a, b, label(a), label(b)) for i, (lang, a, b) in TEXTS.items()], SCHEMA)


def plan(mode, **more):
    return runner.Plan(mode, "dev/val", ("de", "fr", "it"), **more)


def test_a_run_of_both_modes(spark, gold, tmp_path):
    first = runner.predict(spark, str(tmp_path), gold, plan("align", note="kept"))
    second = runner.predict(spark, str(tmp_path), gold, plan("baseline", note="later"), run=first.run_id)
    assert first.path == second.path and not first.capped
    rows = {r.id: r for r in first.details.collect()}
    assert rows["d3"].failed and rows["d3"].error == "a text is missing" and rows["d3"].labels_a is None
    for i in ("d1", "d2", "f1"):
        r = rows[i]
        assert len(r.labels_a) == len(r.text_a.split()) and len(r.labels_b) == len(r.text_b.split()) and r.coverage.a_complete and r.coverage.b_complete
        assert r.coverage.n_ops == len(r.ops) == len(r.judgments) == sum(r.stats.ops.values()) and r.gold_labels_a
        assert [s["index"] for s in r.segments_a] == list(range(len(r.segments_a))) and r.segments_a[-1].end == len(r.labels_a)
        assert all((j is None) == (o.a_start < 0 or o.b_start < 0) for o, j in zip(r.ops, r.judgments, strict=True))
        assert r.provenance.run_id == first.run_id and json.loads(r.provenance.config)["omit_label"] == 0.9
    told = {(r.mode, r.lang): json.loads(r.summary) for r in spark.read.json(f"{first.path}/summary").collect()}
    assert told["align", "de"]["n_completed"] == 2 and told["align", "de"]["n_failed"] == 1 and told["align", "de"]["status"] == "partial"
    assert told["align", "it"]["status"] == "not_started" and told["baseline", "fr"]["status"] == "complete" and "caution" not in told["align", "fr"]
    kept = {r["mode"]: r for r in runner.manifest(spark, first.path).collect()}
    assert kept["align"]["note"] == kept["baseline"]["note"] == "kept" and kept["baseline"]["n_intended"] == {"de": 3, "fr": 1}
    remaining = spark.read.parquet(f"{first.path}/ids").filter("status = 'remaining'").select("mode", "id").collect()
    assert {tuple(r) for r in remaining} == {("align", "d3"), ("baseline", "d3")}


def test_what_was_written_is_evaluated(spark, gold, tmp_path):
    run = runner.predict(spark, str(tmp_path), gold, plan("align"))
    place = files.find_predictions(spark, run.path, "align", "mock", "fr")
    p = files.read_predictions(spark, place).withColumnRenamed("id", "pair_id")
    got = report.evaluate(p, gold.withColumnRenamed("id", "pair_id").filter("lang = 'fr'"), ["fr"]).first()
    assert got["coverage"] == 1.0 and got["n_tokens"] == len(TEXTS["f1"][1].split()) + len(TEXTS["f1"][2].split()) and got["spearman"] is not None
    with pytest.raises(ValueError, match="no prediction"):
        files.find_predictions(spark, run.path, "baseline", "mock", "fr")


def test_slices_and_settings(spark, gold, tmp_path):
    run = runner.predict(spark, str(tmp_path), gold, plan("align", offset=1, limit=1, config=score.ScoreConfig(omit_label=0.5)))
    assert [r.id for r in run.details.collect()] == ["d2"]
    assert {r.lang: r.n_intended for r in run.summary.collect()} == {"de": 1, "fr": 0, "it": 0}
    assert [r.id for r in lifecycle.sliced(gold.select("id"), "id", 2).orderBy("id").collect()] == ["d3", "f1"]


def test_errors_of_a_backend_fail_their_item_only(spark, gold, tmp_path):
    errors = spark.createDataFrame([("d1", "e" * 400)], "pair_id string, error string")
    run = runner.predict(spark, str(tmp_path), gold, plan("baseline"), errors=errors)
    rows = {r.id: r for r in run.details.collect()}
    assert rows["d1"].failed and rows["d1"].error == "e" * 300 and rows["d1"].labels_a is None and not rows["d2"].failed


def test_export_by_run(spark, gold, tmp_path):
    run = runner.predict(spark, str(tmp_path), gold, plan("align"))
    target = tmp_path / "evidence.js"
    assert runner.export(spark, str(tmp_path), run.run_id, "align", str(target)) == 4
    told = json.loads(target.read_text().removeprefix("window.EVIDENCE = ").rstrip().rstrip(";"))
    assert told["run"]["run_id"] == run.run_id and told["run"]["conflict"] == "" and [i["id"] for i in told["items"]] == ["d1", "d2", "d3", "f1"]
    assert runner.export(spark, str(tmp_path), run.run_id, "baseline", str(target)) == 0


def test_no_items(spark, gold, tmp_path):
    run = runner.predict(spark, str(tmp_path), gold.filter("false"), plan("baseline"))
    assert run.details.count() == 0 and {r.status for r in run.summary.collect()} == {"not_started"}
