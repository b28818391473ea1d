"""A run as one call: labels for the pairs of a split, and the files that tell of it.

`align_records` and `baseline_records` make a nested record of every pair: its
segments, operations, judgments, coverage, statistics, labels, gold labels and
where all that comes from.  `predict` writes a run: manifest before anything is
computed, predictions by mode, backend and language, details, ids by status, and
the summary.  Records are written once and everything else is read from there.

Defined cases: a pair without one of its texts, or that a cap left without a
judgment, fails with a reason, has no labels, and does not end the run.  A language
without items is in the summary as not started.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files
from . import align, baseline, judge, lifecycle, pairs, score, segment, similarity, waves
from .stored import met, stored

PROMPTS = "prompts-v2-lang"


@dataclass(frozen=True)
class Plan:
    """What a run is to do. ``backend``: its name; `predict` has the calls themselves."""

    mode: str
    split: str
    languages: tuple[str, ...]
    backend: str = lifecycle.BACKENDS[0]
    config: score.ScoreConfig = field(default_factory=score.ScoreConfig)
    seed: int = 0
    offset: int = 0
    limit: int | None = None
    note: str | None = None


@dataclass
class Steps:
    """The frames of one alignment run over pairs; those that are read again are written."""

    sides: DataFrame
    tokens: DataFrame
    segments: DataFrame
    matrix: DataFrame
    ops: DataFrame
    judged: DataFrame


def steps(items: DataFrame, plan: Plan) -> Steps:
    """``items``: (pair_id, lang, text_a, text_b), judged by the deterministic backend."""
    sides = pairs.sides(items)
    tokens = segment.tokens(sides)
    segments = stored(segment.segments_of(sides), "run-segments")
    matrix = similarity.matrix(segments, plan.seed)
    ops = stored(align.operations_from(segments, plan.seed), "run-operations")
    judged = stored(judge.judgments(ops, segments, plan.seed), "run-judgments")
    return Steps(sides, tokens, segments, matrix, ops, judged)


def provenance(plan: Plan, run_id: str) -> Column:
    told = {"run_id": run_id, "mode": plan.mode, "backend": plan.backend, "split": plan.split, "prompt_version": PROMPTS if plan.backend != lifecycle.BACKENDS[0] else None, "config": json.dumps(asdict(plan.config), sort_keys=True)}
    return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in told.items()]).alias("provenance")


def align_records(s: Steps, plan: Plan) -> DataFrame:
    """(pair_id, labels_a, labels_b, segments_a, segments_b, ops, judgments, coverage, stats): a nested row a pair."""
    labels = baseline.records(score.token_labels(s.tokens, s.ops, s.judged, s.sides, plan.config)).drop("lang")
    part = F.struct(F.col("seg").alias("index"), F.col("tok_lo").alias("start"), F.col("tok_hi").alias("end"), "text")
    side = lambda x: F.sort_array(F.collect_list(F.when(F.col("side") == x, part))).alias(f"segments_{x}")
    segments = s.segments.groupBy("pair_id").agg(side("a"), side("b"))
    spans = {x: f"spans_{x}" if f"spans_{x}" in s.judged.columns else f"span_{x}" for x in "ab"}
    told = s.judged.select("pair_id", "op_idx", "difference", *[(F.col(c) if c.startswith("spans") else F.filter(F.array(c), lambda v: v.isNotNull())).alias(f"spans_{x}") for x, c in spans.items()], (F.col("repairs") if "repairs" in s.judged.columns else F.lit(0)).alias("repairs"))
    j = met(s.ops, told.withColumn("there", F.lit(True)), ["pair_id", "op_idx"], "left")
    op = F.struct("op_idx", "op", "a_start", "a_end", "b_start", "b_end", "sim")
    judgment = F.struct("op_idx", F.when(F.col("there"), F.struct("difference", "spans_a", "spans_b", F.col("difference").isNotNull().alias("ok"), "repairs")).alias("judgment"))
    sorted_list = lambda c: F.sort_array(F.collect_list(c))
    ops = j.groupBy("pair_id").agg(
        sorted_list(op).alias("ops"), F.transform(sorted_list(judgment), lambda x: x["judgment"]).alias("judgments"),
        F.count_if(F.col("there") & F.col("difference").isNull()).alias("parse_failures"), F.sum(F.coalesce("repairs", F.lit(0))).alias("repairs"),
    )
    kinds = s.ops.groupBy("pair_id", "op").agg(F.count(F.lit(1)).alias("n")).groupBy("pair_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("op", "n")))).alias("kinds"))
    matched = score.span_places(s.judged, s.sides).groupBy("pair_id").agg(F.count("pos").alias("span_matched"), F.count_if(F.col("pos").isNull()).alias("span_unmatched"))
    covered = align.coverage(s.ops)
    whole = labels.join(segments, "pair_id", "left")
    for part in (ops, kinds, matched, covered):
        whole = whole.join(part, "pair_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    stats = F.struct(*map(zero, ("parse_failures", "repairs", "span_matched", "span_unmatched")), F.col("kinds").alias("ops"))
    coverage = F.struct(F.coalesce("a_complete", F.lit(False)).alias("a_complete"), F.coalesce("b_complete", F.lit(False)).alias("b_complete"), zero("n_ops"))
    return whole.select("pair_id", "labels_a", "labels_b", "segments_a", "segments_b", "ops", "judgments", coverage.alias("coverage"), stats.alias("stats"))


def baseline_records(items: DataFrame, plan: Plan) -> DataFrame:
    """(pair_id, labels_a, labels_b) by the deterministic whole-document backend."""
    some = F.col("text_a").rlike(T.WORD) | F.col("text_b").rlike(T.WORD)
    return baseline.records_of(items.filter(some), plan.seed).drop("lang")


def details(gold: DataFrame, records: DataFrame, plan: Plan, run_id: str, errors: DataFrame | None = None) -> DataFrame:
    """A record for every item of ``gold`` (id, lang, text_a, text_b and, where known, labels_a, labels_b): `align_records` or
    `baseline_records` with texts, gold labels and provenance; failed with an error where there is none.

    ``errors``: (pair_id, error) of items that a backend did not answer.
    """
    known = [c for c in ("labels_a", "labels_b") if c in gold.columns]
    g = gold.select(F.col("id").alias("pair_id"), "lang", "text_a", "text_b", *[F.col(c).alias(f"gold_{c}") for c in known])
    j = g.join(records, "pair_id", "left")
    if errors is not None:
        j = j.join(errors.groupBy("pair_id").agg(F.min("error").alias("told")), "pair_id", "left")
    told = F.col("told") if errors is not None else F.lit(None).cast("string")
    empty = F.when(F.col("text_a").isNull() | F.col("text_b").isNull(), "a text is missing").when(F.col("labels_a").isNull(), "no tokens")
    rows = lifecycle.failed(j, F.coalesce(told, empty)).drop("told")
    hidden = [F.when(~F.col("failed"), F.col(c)).alias(c) for c in records.columns if c != "pair_id"]
    return rows.select(F.col("pair_id").alias("id"), "lang", "failed", "error", "text_a", "text_b", *hidden, *[f"gold_{c}" for c in known], provenance(plan, run_id))


@dataclass
class Run:
    path: str
    run_id: str
    details: DataFrame
    summary: DataFrame
    capped: bool


def predict(spark: SparkSession, root: str, gold: DataFrame, plan: Plan, run: str | None = None, outcome: waves.Outcome | None = None, records: DataFrame | None = None, errors: DataFrame | None = None) -> Run:
    """Runs one mode over ``gold`` (id, lang, text_a, text_b, labels_a, labels_b) and writes it below ``root``.

    ``run``: the id of a run to add this mode to.  ``records``, ``errors`` and
    ``outcome`` are given where a model, not the deterministic backend, answered.
    """
    began = time.monotonic()
    run_id = run or f"{datetime.now(UTC).strftime('%Y%m%dT%H%M%SZ')}-{uuid.uuid4().hex[:8]}"
    path = f"{root.rstrip('/')}/{run_id}"
    items = gold.filter(F.col("lang").isin(*plan.languages))
    if plan.offset or plan.limit:
        items = lifecycle.sliced_by(items, "lang", "id", plan.offset, plan.limit)
    items = stored(items, "run-items")
    entry = items.groupBy("lang").agg(F.count(F.lit(1)).alias("n_intended"))
    meta = {"run_id": run_id, "mode": plan.mode, "backend": plan.backend, "split": plan.split, "started": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "note": plan.note, "config": json.dumps(asdict(plan.config), sort_keys=True), "seed": plan.seed}
    entry.select(*[F.lit(v).alias(k) for k, v in meta.items()], F.lit(time.time_ns()).alias("at"), "lang", "n_intended").write.mode("append").parquet(f"{path}/manifest")
    items.select(F.lit(plan.mode).alias("mode"), "lang", "id").write.mode("append").partitionBy("mode").parquet(f"{path}/intended")
    texts = items.filter("text_a is not null and text_b is not null").select(F.col("id").alias("pair_id"), "lang", "text_a", "text_b")
    if records is None:
        records = baseline_records(texts, plan) if plan.mode == "baseline" else align_records(steps(texts, plan), plan)
    found = stored(details(items, records, plan, run_id, errors), "run-details")
    capped = bool(outcome and outcome.capped)
    good = found.filter("not failed")
    keys = [F.lit(plan.mode).alias("mode"), F.lit(plan.backend).alias("backend")]
    files.write_predictions(good.select(*keys, "lang", "id", "text_a", "text_b", "labels_a", "labels_b"), path, partial=False)
    files.write_details(found.withColumn("mode", F.lit(plan.mode)), path)
    intended = items.select(F.lit(run_id).alias("run_id"), F.lit(plan.mode).alias("mode"), "lang", "id")
    summary = lifecycle.summaries(intended, found.select(F.lit(run_id).alias("run_id"), F.lit(plan.mode).alias("mode"), "id", "failed"))
    wanted = spark.createDataFrame([(x,) for x in plan.languages], "lang string")
    usage = {"budget_capped": capped, "new_requests": outcome.waves[-1][1] if outcome and outcome.waves else 0, "new_tokens": outcome.waves[-1][2] if outcome and outcome.waves else 0, "elapsed_s": round(time.monotonic() - began, 1)}
    filled = wanted.join(summary.drop("run_id", "mode"), "lang", "left").fillna({"n_intended": 0, "n_completed": 0, "n_failed": 0, "n_remaining": 0, "status": "not_started"})
    filled = filled.select(F.lit(run_id).alias("run_id"), F.lit(plan.mode).alias("mode"), "*", *[F.lit(v).alias(k) for k, v in usage.items()], F.when(F.lit(capped), "partial run: coverage is not complete").alias("caution"))
    lifecycle.summary_json(filled).write.mode("append").json(f"{path}/summary")
    found.select("lang", "id", F.when(F.col("failed"), "remaining").otherwise("completed").alias("status")).withColumn("mode", F.lit(plan.mode)).write.mode("append").partitionBy("mode").parquet(f"{path}/ids")
    return Run(path, run_id, found, stored(filled, "run-summary"), capped)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a run: metadata as first written, each mode's counts as last written."""
    rows = spark.read.parquet(f"{path}/manifest")
    by_mode = rows.groupBy("run_id", "mode", "at", "backend", "split", "started", "note").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n_intended")))).alias("n_intended"))
    return lifecycle.upsert(by_mode)


def evidence(spark: SparkSession, path: str, mode: str, schema: str | None = None) -> DataFrame:
    """The detail records of a mode of a run, with what all of them agree on: (item, backend, prompt_version, conflict)."""
    rows = spark.read.json(f"{path}/details") if schema is None else spark.read.schema(schema).json(f"{path}/details")
    rows = rows.filter(F.col("mode") == mode)
    agree = rows.select("provenance.*").agg(*[F.collect_set(c).alias(c) for c in ("backend", "split", "run_id")])
    one = agree.select(*[F.when(F.size(c) == 1, F.get(c, F.lit(0))).alias(c) for c in agree.columns], F.array_join(F.array_sort(F.flatten(F.array(*[F.when(F.size(c) > 1, F.col(c)).otherwise(F.array().cast("array<string>")) for c in agree.columns]))), ",").alias("conflict"))
    return rows.crossJoin(F.broadcast(one.select(F.struct("*").alias("agreed"))))  # one row


def export(spark: SparkSession, root: str, run_id: str, mode: str, target: str) -> int:
    """Writes the records of a run as a script that sets ``window.EVIDENCE``; returns how many. They pass one by one, not as a whole."""
    rows = evidence(spark, f"{root.rstrip('/')}/{run_id}", mode)
    n = 0
    with open(target, "w", encoding="utf-8") as f:
        for row in rows.select(F.to_json("agreed", {"ignoreNullFields": "false"}).alias("a"), F.to_json(F.struct(*[c for c in rows.columns if c != "agreed"]), {"ignoreNullFields": "false"}).alias("item")).orderBy(F.get_json_object("item", "$.id")).toLocalIterator():
            f.write(f'window.EVIDENCE = {{"run": {row["a"]}, "items": [\n' if not n else ",\n")
            f.write(row["item"].replace('"NaN"', "null"))
            n += 1
        f.write("]};\n" if n else 'window.EVIDENCE = {"run": null, "items": []};\n')
    return n
