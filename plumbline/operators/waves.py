"""Calls of a model under caps, an attempt at a time.

A wave is one Spark job in which every admitted request makes one attempt.  What
fails in a way that may pass, and replies that are not understood, go on to the
next wave; so there are as many waves as one request may make attempts, however
many requests there are, and a cap can be held before every single attempt:

* requests: a wave admits as many attempts as the cap leaves, in order;
* tokens: each attempt reserves what it can cost at most (its messages, and the
  longest reply).  A wave admits the requests whose running sum of reserves fits
  in what the cap leaves; what was not spent is there again for the next wave.

The running sum is a sort by range (`continuous.running`), made only where not
all waiting requests fit.  Answers are written before they are charged or read,
so an attempt is made and paid for once, and a lost executor costs a reread.

Rate: a wave has ``lanes`` tasks at most, whatever the cluster has room for, and
each starts calls ``lanes / per_second`` apart, the lanes one after the other;
so all tasks together keep to ``per_second``.

Defined cases: a null prompt is the empty text; a request that the caps keep from
being answered has neither text nor error, and `Outcome.capped` says that there are some.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import continuous, model, runs
from .stored import stored

_USAGE = {"prompt_tokens": "long", "completion_tokens": "long", "latency_ms": "double", "usage_estimated": "boolean"}
WAITING, ANSWERED, FAILED = "waiting", "answered", "failed"
STATE = "order long, key string, prompt string, replies array<string>, attempts int, tries int, repairs int, tokens long, unknown int, prompt_tokens long, completion_tokens long, latency_ms double, usage_estimated boolean, text string, model string, backend string, error string, status string"


#: Requests that a task handles at once.
PIECE_BYTES, PIECE_ROWS = 2 << 20, 256


@dataclass(frozen=True)
class Rules:
    retries: int = 5
    repairs: int = 1
    max_tokens: int = 512
    lanes: int = 0  # 0: as many tasks as Spark makes of the rows
    per_second: float | None = None
    complaint: str = "Reply with the JSON object only."


@dataclass
class Outcome:
    """``state``: a row for each request; ``waves``: (admitted, attempts so far, tokens so far) of each."""

    state: DataFrame
    capped: bool
    waves: list[tuple[int, int, int]] = field(default_factory=list)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, PIECE_BYTES or PIECE_ROWS at a time, about: what a task holds as Python values."""
    for b in batches:
        step = max(1, min(PIECE_ROWS, int(PIECE_BYTES * b.num_rows // max(b.nbytes, 1))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def attempt(admitted: DataFrame, backend: Callable[[], model.Backend], understood: Callable[[str, str], bool], rules: Rules) -> DataFrame:
    """STATE rows after one attempt each."""
    names = [c.split()[0] for c in STATE.split(", ")]

    kinds = to_arrow_schema(StructType.fromDDL(STATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = backend()
        gap = rules.lanes / rules.per_second if rules.per_second else 0.0
        next_at = time.monotonic() + (TaskContext.get().partitionId() / rules.per_second if gap else 0.0)
        for few in pieces(batches):
            rows = []
            for row in few.to_pylist():
                if gap:
                    time.sleep(max(0.0, next_at - time.monotonic()))
                    next_at = time.monotonic() + gap
                said, prompt, tries = row["replies"], row["prompt"] or "", row["tries"]
                messages = [{"role": "user", "content": prompt}]
                for text in said:
                    messages += [{"role": "assistant", "content": text}, {"role": "user", "content": rules.complaint}]
                row |= {"attempts": row["attempts"] + 1, "tries": tries + 1}
                try:
                    reply = client.complete(messages, rules.max_tokens, 0.0, tries)
                    known = reply.prompt_tokens is not None and reply.completion_tokens is not None
                    row |= {"tokens": row["tokens"] + (reply.prompt_tokens + reply.completion_tokens if known else 0), "unknown": row["unknown"] + (not known)}
                    row |= {"prompt_tokens": reply.prompt_tokens, "completion_tokens": reply.completion_tokens, "latency_ms": reply.latency_ms, "usage_estimated": reply.usage_estimated}
                    row |= {"text": reply.text, "model": reply.model, "backend": reply.backend, "error": None, "status": ANSWERED}
                    if not understood(reply.text, prompt) and len(said) < rules.repairs:
                        row |= {"replies": [*said, reply.text], "repairs": row["repairs"] + 1, "tries": 0, "status": WAITING}
                except model.Unavailable as e:
                    ended = not e.passing or tries >= rules.retries
                    row |= {"unknown": row["unknown"] + 1, "error": str(e)[:300], "status": FAILED if ended else WAITING}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    if rules.lanes:
        admitted = admitted.repartition(rules.lanes)
    return admitted.select(*names).mapInArrow(run, STATE)


def reserve(rules: Rules) -> Column:
    """What an attempt can cost at most, in tokens of four characters."""
    said = F.reduce("replies", F.lit(0), lambda n, text: n + F.length(text) + len(rules.complaint))
    return (F.coalesce(F.length("prompt"), F.lit(0)) + said).cast("long") + rules.max_tokens


def run(
    requests: DataFrame,
    backend: Callable[[], model.Backend],
    understood: Callable[[str, str], bool] = lambda text, prompt: True,
    budget: runs.Budget | None = None,
    rules: Rules = Rules(),
    sleep: Callable[[float], None] = time.sleep,
) -> Outcome:
    """Answers ``requests`` (key, prompt; keys distinct) within ``budget``, which is charged; ``understood(text, prompt)`` judges a reply."""
    if rules.per_second and not rules.lanes:
        raise ValueError("a rate needs a number of lanes")
    budget = budget or runs.Budget(1 << 62, 1 << 62)
    numbered = runs.numbered(requests.select("key", "prompt"), "key")
    none = {"replies": F.array().cast("array<string>"), **{c: F.lit(0) for c in ("attempts", "tries", "repairs", "unknown")}, "tokens": F.lit(0).cast("long")}
    none |= {c: F.lit(None).cast(t) for c, t in _USAGE.items()}
    none |= {c: F.lit(None).cast("string") for c in ("text", "model", "backend", "error")} | {"status": F.lit(WAITING)}
    columns = [c.split()[0] for c in STATE.split(", ")]
    state = stored(numbered.withColumns(none).withColumn("order", F.col("order").cast("long")).select(*columns), "wave-requests")
    waves: list[tuple[int, int, int]] = []
    done: list[DataFrame] = []  # rows that wait no longer, wave by wave
    waiting = state
    cost = reserve(rules)
    failures = 0
    while True:
        needs = waiting.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cost), F.lit(0)).alias("t")).first()
        if not needs["n"]:
            return Outcome(_whole(done, state), False, waves)
        requests_left, tokens_left = budget.max_requests - budget.requests, budget.max_tokens - budget.tokens
        if requests_left <= 0 or tokens_left <= 0:
            return Outcome(_whole([*done, waiting], state), True, waves)
        if needs["n"] <= requests_left and needs["t"] <= tokens_left:
            admitted, later = waiting, None
        else:
            priced = waiting.withColumns({"all": F.lit(0), "one": F.lit(1), "cost": cost})
            summed = stored(continuous.running(priced, ["all"], "order", "one", "cost"), "wave-reserves")
            fits = (F.col("before_one") < requests_left) & (F.col("before_cost") + F.col("cost") <= tokens_left)
            admitted, later = summed.filter(fits).select(*columns), summed.filter(~fits).select(*columns)
            if admitted.isEmpty():
                return Outcome(_whole([*done, waiting], state), True, waves)
        if failures:
            sleep(min(2.0 ** (failures - 1), 30.0))
        before = admitted.agg(F.sum("attempts").alias("a"), F.sum("tokens").alias("t"), F.sum("unknown").alias("u")).first()
        answered = stored(attempt(admitted, backend, understood, rules), "wave-answers")
        after = answered.agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("a"), F.sum("tokens").alias("t"), F.sum("unknown").alias("u"), F.count_if((F.col("status") == WAITING) & (F.col("tries") > 0)).alias("failed")).first()
        budget.charge(after["a"] - before["a"], after["t"] - before["t"], after["u"] - before["u"])
        waves.append((after["n"], budget.requests, budget.tokens))
        failures = failures + 1 if after["failed"] else 0
        done.append(answered.filter(F.col("status") != WAITING))
        waiting = answered.filter(F.col("status") == WAITING)
        if later is not None:
            waiting = waiting.unionByName(later)


def _whole(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.filter("false")
    for p in parts:
        out = out.unionByName(p)
    return out


def replay(requests: DataFrame, replies: DataFrame) -> Outcome:
    """Answers from a table of known replies (key, text): an equality join in place of a backend."""
    told = requests.select("key", "prompt").join(replies.select("key", "text").dropDuplicates(["key"]), "key", "left")
    known = F.col("text").isNotNull()
    used = F.floor((F.length("prompt") + F.length("text")) / 4).cast("long")
    columns = {"order": F.lit(0).cast("long"), "replies": F.array().cast("array<string>"), "attempts": F.lit(1), "tries": F.lit(1), "repairs": F.lit(0), "tokens": F.coalesce(used, F.lit(0)), "unknown": (~known).cast("int")}
    columns |= {"prompt_tokens": F.floor(F.length("prompt") / 4).cast("long"), "completion_tokens": F.floor(F.length("text") / 4).cast("long"), "latency_ms": F.lit(0.0), "usage_estimated": F.lit(True)}
    columns |= {"model": F.lit("replay"), "backend": F.lit("replay"), "error": F.when(~known, F.lit("no reply is known")), "status": F.when(known, F.lit(ANSWERED)).otherwise(F.lit(FAILED))}
    return Outcome(told.withColumns(columns).select(*[c.split()[0] for c in STATE.split(", ")]), False)


def invoke(requests: DataFrame, cache: DataFrame, ask: Callable[[DataFrame], Outcome]) -> tuple[DataFrame, DataFrame, Outcome]:
    """(requests with text, cached, error; new cache entries; what was done) for requests (n, key, prompt) and a memory (key, text, model, backend).

    Each key that the memory lacks is asked for once.
    """
    known = cache.filter("text is not null").dropDuplicates(["key"]).select("key", "text")
    missing = requests.groupBy("key").agg(F.min("prompt").alias("prompt")).join(known.select("key"), "key", "left_anti")
    outcome = ask(missing)
    new = outcome.state.filter(F.col("status") == ANSWERED)
    told = known.select("key", "text", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")).unionByName(outcome.state.filter(F.col("status") != WAITING).select("key", F.when(F.col("status") == ANSWERED, F.col("text")).alias("text"), F.lit(False).alias("cached"), "error"))
    return requests.join(told, "key", "left").drop("prompt"), new.select("key", "text", "model", "backend"), outcome


def call_log(requests: DataFrame, found: DataFrame, state: DataFrame, run_id: str, kind: str) -> DataFrame:
    """Call-log rows, one for each request (n, key, prompt, split, item_id) that was answered, failed, or found in the memory.

    ``found`` and ``state`` are what `invoke` returns.  The usage of a call that
    several requests share stands with the first of them; the others are cached.
    """
    told = state.select("key", "model", "backend", "error", *_USAGE, (F.col("status") == ANSWERED).alias("ok"))
    j = requests.join(found.select("n", "cached"), "n").filter("cached is not null").join(told, "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy("n")) == 1
    called = ~F.col("cached") & F.col("_first")
    usage = [F.when(called, F.col(c)).alias(c) for c in _USAGE]
    return j.withColumn("_first", first).select(
        F.current_timestamp().alias("ts"), F.lit(run_id).alias("run_id"), "split", "item_id", F.lit(kind).alias("kind"), "backend", "model", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_sha256"),
        F.coalesce(F.length("prompt"), F.lit(0)).cast("long").alias("prompt_chars"), *usage, (~called).alias("cached"), F.coalesce("ok", F.lit(True)).alias("ok"), "error",
    )
