"""Extension: predictions scored as they arrive, and call rates over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import files


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(files.PREDICTION).json(path)


def call_rates(calls: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls in tumbling windows of their timestamp; later rows than the watermark are dropped."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("calls"))


def each_batch(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores every micro-batch with a batch operator and writes it to a folder of its number: a batch that is tried again replaces what it wrote."""

    def write(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
