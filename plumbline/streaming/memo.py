"""Extension: requests answered as they arrive, each key once, across batches and restarts.

Equal requests of the last while are dropped by the stream's own state (its size is
bounded by the watermark).  What passes is looked up in all answers written so far;
only keys that are not there are asked for.  A micro-batch's answers are a folder of
its number, written before the batch is committed: a batch that is tried again finds
its folder complete and asks nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import waves

ANSWER = "key string, text string, model string, backend string, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def answers(spark: SparkSession, out: str) -> DataFrame:
    """Every answer so far; none where nothing was written yet."""
    return spark.read.schema(ANSWER).parquet(out) if _exists(spark, out) else spark.createDataFrame([], ANSWER)


def answer_once(requests: DataFrame, ask: Callable[[DataFrame], waves.Outcome], out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Starts answering a stream (ts, key, prompt) into the folder ``out``; ``ask`` answers a batch (key, prompt) of distinct new keys.

    Requests that the backend was not available for, or that a cap kept back, are
    not remembered: the next request of their key asks again.
    """
    fresh = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{out}/batch={number}"
        if _exists(spark, f"{folder}/_SUCCESS"):
            return
        known = answers(spark, out).filter("text is not null").select("key").distinct()
        missing = batch.groupBy("key").agg(F.min("prompt").alias("prompt")).join(known, "key", "left_anti")
        state = ask(missing).state.filter(F.col("status") != waves.WAITING)
        text = F.when(F.col("status") == waves.ANSWERED, F.col("text")).alias("text")
        state.select("key", text, "model", "backend", "error").write.mode("overwrite").parquet(folder)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answered(requests: DataFrame, out: str) -> DataFrame:
    """Requests (a batch frame with key) with the text of their key's answer, null without one."""
    told = answers(requests.sparkSession, out).filter("text is not null").groupBy("key").agg(F.min("text").alias("text"))
    return requests.join(told, "key", "left")
