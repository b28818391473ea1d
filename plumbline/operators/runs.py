"""Run metadata: manifests, status, provenance, cache, budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stored import stored


def language_status(intended: DataFrame, completed: DataFrame, started: DataFrame) -> DataFrame:
    """(lang, n_intended, n_completed, n_remaining, status) for each intended language."""
    i = intended.groupBy("lang").agg(F.count(F.lit(1)).alias("n_intended"))
    c = completed.groupBy("lang").agg(F.count(F.lit(1)).alias("n_completed"))
    j = i.join(c, "lang", "left").join(started.select("lang").distinct().withColumn("on", F.lit(True)), "lang", "left")
    done = F.coalesce("n_completed", F.lit(0))
    status = F.when(done >= F.col("n_intended"), "complete").when(done > 0, "partial").when(F.col("on"), "started_no_output").otherwise("not_started")
    return j.select("lang", "n_intended", done.alias("n_completed"), (F.col("n_intended") - done).alias("n_remaining"), status.alias("status"))


def remaining(intended: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return intended.join(completed.select(key), key, "left_anti")


def consensus(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): the value if all rows of a key have the same one, else null and the sorted values."""
    seen = rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("seen"))
    return seen.select(key, F.when(F.size("seen") == 1, F.get("seen", F.lit(0))).alias("value"), F.when(F.size("seen") > 1, F.array_join("seen", ",")).alias("conflict"))


def content_key(*parts: Column) -> Column:
    """Content address of a request: a digest of its parts as canonical JSON."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def hits_and_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests with ``cached``; each key counts once in the cache."""
    known = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    return requests.join(known, key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def usage(calls: DataFrame, by: str) -> DataFrame:
    """Requests, estimated tokens (a quarter of the characters) and calls of unknown usage, from a call log (chars)."""
    tokens = F.floor(F.col("chars") / 4)
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count_if(F.col("chars").isNull()).alias("no_usage"))


class BudgetExceeded(RuntimeError):
    """The next attempt would start with a cap already reached."""


@dataclass
class Budget:
    """Caps on new calls of a run; the driver asks before each micro-batch and charges it afterwards."""

    max_requests: int = 500
    max_tokens: int = 600_000
    requests: int = 0
    tokens: int = 0
    unknown: int = 0

    def preflight(self) -> None:
        for what, now, cap in (("request", self.requests, self.max_requests), ("token", self.tokens, self.max_tokens)):
            if now >= cap:
                raise BudgetExceeded(f"{what} cap reached ({now}/{cap})")

    def charge(self, requests: int, tokens: int, unknown: int = 0) -> None:
        self.requests += requests
        self.tokens += tokens
        self.unknown += unknown


def numbered(requests: DataFrame, by: str) -> DataFrame:
    """``requests`` with distinct numbers ``order`` from 0, by ``by``: runs of rows are counted, then numbered within their task."""
    spark = requests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(requests.repartitionByRange(parts, by).withColumn("_task", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # a row a task
    before = sizes.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_task").orderBy(by)) - 1
    return dealt.withColumn("_at", place).join(F.broadcast(before), "_task").withColumn("order", F.col("_before") + F.col("_at")).drop("_task", "_at", "_before")


def union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f.select(*out.columns))
    return out


def within_budget(requests: DataFrame, order: str, call: Callable[[DataFrame], DataFrame], budget: Budget, batch: int = 20, worst: int = 1) -> tuple[list[DataFrame], bool]:
    """Calls a backend on ordered batches until done or the budget stops it: (answers, capped).

    ``requests`` needs an ordered column ``order`` of distinct numbers from 0;
    ``call`` answers a batch with a column ``tokens`` (null where unknown) and,
    if it has one, ``attempts``.  A batch, one Spark job, is of ``batch`` requests, or as
    many as what the request cap leaves bears at ``worst`` attempts each; its answers are
    written once, charged from what was written, and read from there.  For many
    requests, or caps that hold at each attempt, see `waves`.
    """
    n = requests.count()
    answers: list[DataFrame] = []
    at = 0
    while at < n:
        try:
            budget.preflight()
        except BudgetExceeded:
            return answers, True
        size = min(batch, n - at, (budget.max_requests - budget.requests) // worst)
        if not size:
            return answers, True
        answer = stored(call(requests.filter((F.col(order) >= at) & (F.col(order) < at + size))), "answers")
        tries = F.sum("attempts") if "attempts" in answer.columns else F.count(F.lit(1))
        told = answer.agg(tries.alias("n"), F.sum("tokens").alias("t"), F.count_if(F.col("tokens").isNull()).alias("u")).first()
        budget.charge(told["n"] or 0, told["t"] or 0, told["u"])
        answers.append(answer)
        at += size
    return answers, False
