"""Sources and sinks: gold and prediction files, manifests, call log, cache, evidence export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guard

GOLD = "id string, text_a string, text_b string, labels_a array<double>, labels_b array<double>, annotator_tag int"
PREDICTION = "id string, text_a string, text_b string, labels_a array<double>, labels_b array<double>"
CALL = (
    "ts timestamp, run_id string, split string, item_id string, kind string, backend string, model string, prompt_sha256 string, prompt_chars long, "
    "prompt_tokens long, completion_tokens long, latency_ms double, usage_estimated boolean, cached boolean, ok boolean, error string"
)
CACHE = "key string, text string, model string, backend string"


def read_gold(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Gold pairs of a JSON-lines file; every label array must have its text's token count, every id be known."""
    df = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    for s in "ab":
        right = F.size(T.split_words(F.col(f"text_{s}"))) == F.size(f"labels_{s}")
        df = df.withColumn(f"labels_{s}", F.when(right, F.col(f"labels_{s}")).otherwise(F.raise_error(F.concat(F.lit("labels and tokens differ in "), "id")).cast("array<double>")))
    if manifest is not None:
        guard.assert_known(df.select("id"), manifest)
    return df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records of one language with ``file`` they came from; more than one file is an error."""
    df = spark.read.schema(PREDICTION).json(path).withColumn("file", F.col("_metadata.file_path"))
    found = [r["file"] for r in df.select("file").distinct().limit(3).collect()]
    if len(found) > 1:
        raise ValueError(f"several prediction files: {sorted(found)}")
    return df


def find_predictions(spark: SparkSession, run: str, mode: str, backend: str, lang: str, prefix: str = "") -> str:
    """The one file of a run's predictions of a mode, backend and language whose name begins with ``prefix``; none, or several, is an error."""
    folder = f"{run.rstrip('/')}/predictions/mode={mode}/backend={backend}/lang={lang}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*.json")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    names = sorted(f.getPath().toString() for f in found or [])
    if len(names) != 1:
        raise ValueError(f"several prediction files: {names[:3]}" if names else f"no prediction file in {folder}")
    return names[0]


def write_predictions(df: DataFrame, path: str, partial: bool = False) -> None:
    """One folder for each mode, backend and language; what a cap cut short goes to a place of its own."""
    df.write.partitionBy("mode", "backend", "lang").mode("append").json(f"{path}/partial" if partial else f"{path}/predictions")


def write_details(df: DataFrame, path: str) -> None:
    """Nested detail records, failed items among them; null fields are left out."""
    df.write.mode("append").json(f"{path}/details")


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON that must be valid and finite: NaN and Infinity fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").option("multiLine", "true").json(path)


def id_manifest(*frames: DataFrame) -> DataFrame:
    """Distinct ids of all frames, sorted."""
    one, *rest = [f.select("id") for f in frames]
    for f in rest:
        one = one.unionByName(f)
    return one.distinct().orderBy("id")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def held_out_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` whose names tell of held-out material."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.filter(guard.forbidden_path(F.replace("path", F.lit(path), F.lit(""))))


def append_calls(df: DataFrame, path: str) -> None:
    df.write.partitionBy("run_id").mode("append").parquet(path)


def put_cache(df: DataFrame, path: str) -> None:
    """New entries only: keys that the cache has already are left alone."""
    df = df.join(read_cache(df.sparkSession, path).select("key"), "key", "left_anti")
    df.dropDuplicates(["key"]).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """One entry a key, whatever two writers at once have added; no entries where there is no folder. An entry without text is a miss."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    first = F.min(F.struct("text", "model", "backend")).alias("e")
    return spark.read.schema(CACHE).parquet(path).filter("text is not null").groupBy("key").agg(first).select("key", "e.*")


def export_evidence(document: DataFrame, path: str) -> None:
    """A one-row frame as a script that sets ``window.EVIDENCE``; nulls stay null, NaN becomes null."""
    row = document.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    clean = json.loads(row.replace('"NaN"', "null"))
    with open(path, "w", encoding="utf-8") as f:
        f.write("window.EVIDENCE = " + json.dumps(clean, ensure_ascii=False, allow_nan=False) + ";\n")
