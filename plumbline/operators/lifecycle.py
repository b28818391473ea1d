"""A run from its plan to its report: directories, manifests, summaries, failed items, roll-up."""

from __future__ import annotations

import json
import subprocess
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import guard, pairs

BACKENDS = ("mock", "hosted")
MODES = ("align", "baseline")
MANIFEST = "run_id string, mode string, at long, backend string, split string, started string, note string, lang string, ids array<string>"


class Refused(ValueError):
    """A setting contradicts another one, or is unknown."""


def new_run(root: str, now: datetime | None = None) -> str:
    """A new folder name: UTC time and eight hexadecimal digits; a name that is there is never used again."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    while (path := Path(root) / f"{stamp}-{uuid.uuid4().hex[:8]}").exists():
        pass
    return str(path)


def source_state(folder: str = ".", fallback: str | None = None) -> dict:
    """Commit and whether the tree is changed, from git or else what the caller knows."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    try:
        return {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return {"commit": fallback, "dirty": None}


def resolve_backend(asked: str | None, environment: str | None) -> str:
    """The backend asked for, else the environment's, else the deterministic one; the two must not contradict each other."""
    if asked and environment and asked != environment:
        raise Refused(f"{asked} asked for, {environment} set")
    found = asked or environment or BACKENDS[0]
    if found not in BACKENDS:
        raise Refused(f"unknown backend {found}")
    return found


def languages(lang: str) -> list[str]:
    """One language, or all of them."""
    if lang == "all":
        return list(guard.LANGUAGES)
    if lang not in guard.LANGUAGES:
        raise guard.HeldOut(f"language {lang}")
    return [lang]


def assert_dev_path(path: str) -> str:
    """Gold must lie in a dev folder."""
    parts = [p.lower() for p in Path(path).parts]
    if "gold" in parts and "dev" not in parts:
        raise guard.HeldOut(f"not a dev file: {path}")
    return path


def sliced(items: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Items from ``offset`` on in an order; a limit of 0 or none is no limit."""
    if not limit:
        return sliced_by(items.withColumn("_all", F.lit(0)), "_all", order, offset).drop("_all")
    return items.orderBy(order).offset(offset).limit(limit)


def sliced_by(items: DataFrame, group: str, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """As `sliced`, in each group: places come from a sort by range, so no partition gets all rows."""
    place = pairs.ranked(items, [group], order)
    last = F.col("r") <= offset + limit if limit else F.lit(True)
    return place.filter((F.col("r") > offset) & last).select(*items.columns)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id) of an id manifest file."""
    return spark.read.schema("commit string, ids array<string>").option("multiLine", "true").json(path).select(F.explode("ids").alias("id")).distinct()


def load_config(given: dict | None, calibrated: str | None, defaults: dict) -> dict:
    """Settings given, else those of the calibration file, else the defaults; unknown names are refused."""
    found = given if given is not None else json.loads(Path(calibrated).read_text())["config"] if calibrated and Path(calibrated).exists() else {}
    if set(found) - set(defaults):
        raise Refused(f"unknown settings {sorted(set(found) - set(defaults))}")
    return defaults | found


def upsert(entries: DataFrame, order: str = "at") -> DataFrame:
    """Manifest rows (run_id, mode, ...): metadata as first written for the run, each mode's entry as last written."""
    first = Window.partitionBy("run_id").orderBy(order)
    last = Window.partitionBy("run_id", "mode").orderBy(F.col(order).desc())
    meta = [c for c in ("backend", "split", "started", "note") if c in entries.columns]
    whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = entries.withColumns({c: F.first(c, ignorenulls=True).over(whole) for c in meta})
    return kept.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def failed(items: DataFrame, error: Column) -> DataFrame:
    """``items`` with failed and the error's first 300 characters: a failed item does not end a run."""
    return items.withColumn("failed", error.isNotNull()).withColumn("error", F.left(error, F.lit(300)))


def summaries(intended: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, mode, lang, n_intended, n_completed, n_failed, n_remaining, status) for intended (run_id, mode, lang, id) and outcomes (run_id, mode, id, failed)."""
    o = outcomes.select("run_id", "mode", "id", "failed")
    j = intended.join(o, ["run_id", "mode", "id"], "left").groupBy("run_id", "mode", "lang").agg(
        F.count(F.lit(1)).alias("n_intended"), F.count_if(~F.col("failed")).alias("n_completed"), F.count_if(F.col("failed")).alias("n_failed")
    )
    left = F.col("n_intended") - F.col("n_completed")
    seen = F.col("n_completed") + F.col("n_failed")
    status = F.when(left == 0, "complete").when(F.col("n_completed") > 0, "partial").when(seen > 0, "started_no_output").otherwise("not_started")
    return j.withColumn("n_remaining", left).withColumn("status", status)


def summary_json(summary: DataFrame) -> DataFrame:
    """(run_id, mode, lang, summary): the row as JSON; null fields are left out."""
    keys = [c for c in summary.columns if c not in ("run_id", "mode", "lang")]
    return summary.select("run_id", "mode", "lang", F.to_json(F.struct(*keys)).alias("summary"))


def roll_up(summary: DataFrame, split_sizes: DataFrame, capped: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(run_id, produced, not_produced, coverage, partial): a row a run.

    ``summary`` from `summaries`; ``split_sizes`` (lang, n); ``capped`` (run_id, capped).  A mode
    is produced when it completed an item; coverage is of the whole split; a run
    is partial if it was capped, lacks a mode, or left intended items.
    """
    per_mode = summary.join(split_sizes.withColumnRenamed("n", "n_split"), "lang", "left").groupBy("run_id", "mode").agg(
        F.sum("n_completed").alias("done"), F.sum("n_intended").alias("planned"), F.sum("n_split").alias("n_split")
    )
    wanted = F.array(*map(F.lit, modes))
    r = per_mode.groupBy("run_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("done") > 0, F.col("mode")))).alias("made"), F.bool_or(F.col("done") < F.col("planned")).alias("short"),
        F.round(F.try_divide(F.sum("done"), F.sum("n_split")), 4).alias("coverage"),
    ).join(capped, "run_id", "left")
    gone = F.filter(wanted, lambda m: ~F.array_contains("made", m))
    return r.select(
        "run_id", F.array_join("made", ",").alias("produced"), F.array_join(gone, ",").alias("not_produced"), "coverage",
        (F.coalesce("capped", F.lit(False)) | (F.size(gone) > 0) | F.col("short")).alias("partial"),
    )


def known_defect(prompt_version: Column, lang: Column) -> Column:
    """What is known to be wrong with a run: the first prompts named one language whatever the text's."""
    first = F.coalesce(prompt_version, F.lit("v1")).endswith("v1")  # runs that tell no version are as old
    return F.when(first & (lang != "de"), F.lit("judged with a prompt that names another language"))


def limitations(backend: Column) -> Column:
    """What a reader of a run has to know, in order; the deterministic backend says so first."""
    always = ["labels are per token of white-space text", "gold covers part of the split", "intervals come from resampling tokens or documents"]
    return F.concat(F.when(backend == BACKENDS[0], F.array(F.lit("labels come from word overlap, not from a model"))).otherwise(F.array().cast("array<string>")), F.array(*map(F.lit, always)))


def heat(label: Column) -> Column:
    """A label as the share of full colour: clamped to 0..1, none for what is not scored."""
    return F.when(label >= 0, F.least(F.lit(1.0), label))
