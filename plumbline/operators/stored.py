"""Steps that several later ones read, and the folder they are kept in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one where that is unset and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", "").rstrip("/")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="plumbline-"))
        folder = _own[0]
    return f"{folder}/plumbline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` made once: written in a shared folder and read again, so that the loss of an executor costs a reread."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The join of two steps that grow with the texts, of which neither is sent whole to the driver and all tasks.

    Spark takes a stored step for as large as the columns' share of its compressed files, and what is exploded from a row
    for one row: millions of operations then look small enough to be broadcast.
    """
    return left.join(right.hint("merge"), on, how)
