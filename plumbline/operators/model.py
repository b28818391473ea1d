"""Calls of a model: prompts, memory, repair, retry, throttle and budget.

A backend is any object with ``complete(messages, max_tokens, temperature,
seed)`` that returns a `Reply` or raises `Unavailable`.  Requests are rows (n,
key, prompt); what the memory holds is joined, the rest is called once for each
key in micro-batches that the driver releases one after the other, so that a cap
holds at every batch.  A batch's answers are written before they are charged or
read, so nothing is called, or paid for, twice.

Defined cases: a null prompt is the empty text; requests of one key are one call;
an unavailable backend gives a row with ``error`` and does not end the run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from . import runs
from .stored import stored

LANGUAGE_NAMES = {"de": "German", "fr": "French", "it": "Italian", "es": "Spanish", "en": "English"}
PAIRS_A_CALL = 20
ANSWER = "key string, text string, model string, backend string, tokens long, attempts int, repairs int, error string"


@dataclass(frozen=True)
class Reply:
    text: str
    model: str = "replay"
    backend: str = "replay"
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    latency_ms: float = 0.0
    usage_estimated: bool = False


class Unavailable(RuntimeError):
    """The backend did not answer; ``passing`` if it may on another attempt."""

    def __init__(self, reason: str, passing: bool = True):
        super().__init__(reason)
        self.passing = passing


class Backend(Protocol):
    def complete(self, messages: list[dict], max_tokens: int, temperature: float, seed: int) -> Reply: ...


@dataclass
class Replay:
    """A backend that answers from a table of prompts; unknown prompts are unavailable for good."""

    replies: dict[str, str]

    def complete(self, messages: list[dict], max_tokens: int = 0, temperature: float = 0.0, seed: int = 0) -> Reply:
        prompt = messages[-1]["content"]
        if prompt not in self.replies:
            raise Unavailable("no reply is known", passing=False)
        return estimated(Reply(self.replies[prompt]), prompt)


def estimated(reply: Reply, prompt: str) -> Reply:
    """The reply with its usage taken as a quarter of the characters where the backend told none."""
    if reply.prompt_tokens is not None and reply.completion_tokens is not None:
        return reply
    return replace(reply, prompt_tokens=len(prompt) // 4, completion_tokens=len(reply.text) // 4, usage_estimated=True)


@dataclass
class Patient:
    """A backend that waits between calls and tries again what may pass: ``attempts`` counts all tries."""

    inner: Backend
    retries: int = 5
    per_second: float | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    attempts: int = 0
    _last: float | None = None

    def complete(self, messages: list[dict], max_tokens: int = 512, temperature: float = 0.0, seed: int = 0) -> Reply:
        for k in range(self.retries + 1):
            if self.per_second and self._last is not None and (wait := self._last + 1 / self.per_second - self.clock()) > 0:
                self.sleep(wait)
            self._last = self.clock()
            self.attempts += 1
            try:
                return self.inner.complete(messages, max_tokens, temperature, seed)
            except Unavailable as e:
                if not e.passing or k == self.retries:
                    raise
            self.sleep(min(2.0**k, 30.0))
        raise AssertionError


def repaired(backend: Backend, prompt: str, understood: Callable[[str], bool], complaint: str, repairs: int = 1) -> tuple[Reply, int]:
    """The reply and how many repairs it took: a reply that is not understood is sent back with the complaint."""
    messages = [{"role": "user", "content": prompt}]
    reply = backend.complete(messages, 512, 0.0, 0)
    for k in range(repairs):
        if understood(reply.text):
            return reply, k
        messages += [{"role": "assistant", "content": reply.text}, {"role": "user", "content": complaint}]
        reply = backend.complete(messages, 512, 0.0, 0)
    return reply, repairs


def answered(requests: DataFrame, backend: Callable[[], Backend], understood: Callable[[str], bool] = lambda text: True, complaint: str = "Reply with the JSON object only.", retries: int = 5, per_second: float | None = None) -> DataFrame:
    """ANSWER rows for requests (key, prompt): one call each, with repairs; ``per_second`` holds for each task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patient = Patient(backend(), retries, per_second)
        for f in frames:
            rows = []
            for key, prompt in zip(f["key"], f["prompt"], strict=True):
                patient.attempts = 0
                try:
                    reply, repairs = repaired(patient, prompt or "", understood, complaint)
                    known = None if reply.prompt_tokens is None or reply.completion_tokens is None else reply.prompt_tokens + reply.completion_tokens
                    rows.append((key, reply.text, reply.model, reply.backend, known, patient.attempts, repairs, None))
                except Unavailable as e:
                    rows.append((key, None, None, None, None, patient.attempts, 0, str(e)[:300]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])
            out["tokens"] = out["tokens"].astype("Int64")
            yield out

    return requests.select("key", "prompt").mapInPandas(run, ANSWER)


def invoke(requests: DataFrame, cache: DataFrame, call: Callable[[DataFrame], DataFrame], budget: runs.Budget | None = None, batch: int = 20) -> tuple[DataFrame, DataFrame, bool]:
    """(requests with text, cached, error; new cache entries; capped) for requests (n, key, prompt) and a memory (key, text, model, backend).

    Requests that the budget kept from being called have neither text nor error.
    """
    known = cache.filter("text is not null").dropDuplicates(["key"]).select("key", "text")
    missing = requests.select("key", "prompt").groupBy("key").agg(F.min("prompt").alias("prompt")).join(known.select("key"), "key", "left_anti")
    answers, capped = runs.within_budget(stored(runs.numbered(missing, "key"), "requests"), "order", call, budget or runs.Budget(1 << 62, 1 << 62), batch)
    new = runs.union(answers, requests.sparkSession, ANSWER)
    told = known.select("key", "text", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error")).unionByName(new.select("key", "text", F.lit(False).alias("cached"), "error"))
    return requests.join(told, "key", "left").drop("prompt"), new.filter("text is not null").select("key", "text", "model", "backend"), capped


# Prompts carry their request as one JSON line between marks, which `request_of` takes out again.
REQUEST_MARKS = ("<request>", "</request>")


def request_block(kind: str, *fields: Column) -> Column:
    return F.concat(F.lit(REQUEST_MARKS[0]), F.to_json(F.struct(F.lit(kind).alias("kind"), *fields)), F.lit(REQUEST_MARKS[1]))


def request_of(prompt: Column) -> Column:
    """The JSON of a prompt's request; null without one."""
    return F.nullif(F.regexp_extract(prompt, f"(?s){REQUEST_MARKS[0]}(.*?){REQUEST_MARKS[1]}", 1), F.lit(""))


def language_name(lang: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, lang), lang)


def similarity_prompt(lang: Column, pairs: Column) -> Column:
    """``pairs``: array of (i, j, a, b) of one batch."""
    return F.concat(F.lit("Rate from 0 to 5 how close in meaning each English passage a and "), language_name(lang), F.lit(" passage b are. Reply as JSON with scores: i, j, score.\n"), request_block("similarity", pairs.alias("pairs")))


def judge_prompt(lang: Column, a: Column, b: Column) -> Column:
    return F.concat(
        F.lit("Rate from 0 to 5 how much the English passage side_a and the "), language_name(lang),
        F.lit(" passage side_b differ in meaning. Reply as JSON with semantic_difference and differing_spans: side_a, side_b.\n"), request_block("judge", a.alias("side_a"), b.alias("side_b")),
    )


def baseline_prompt(lang: Column, a: Column, b: Column) -> Column:
    """``a``, ``b``: token arrays; they are shown as sentences too."""
    return F.concat(
        F.lit("Label every token of the English sentence1 and the "), language_name(lang), F.lit(" sentence2 from 0 (different) to 5 (equal), punctuation -1. Reply as JSON lists of [token, label].\n"),
        sentence(a), F.lit("\n"), sentence(b), F.lit("\n"), request_block("baseline", a.alias("sentence1"), b.alias("sentence2")),
    )


def sentence(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def call_key(model: Column, prompt: Column, repair: Column) -> Column:
    """A call's place in the memory: equal prompts of one model share it, each repair has its own."""
    return runs.content_key(model, prompt, repair)


def judge_understood(text: str) -> bool:
    return parsing.judgment(text, "", "") is not None


def is_complete(emitted_a: Column, emitted_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """Whether a whole-document reply labels half the tokens of either side, or more."""
    return (2 * emitted_a >= tokens_a) & (2 * emitted_b >= tokens_b)


def log_rows(requests: DataFrame, answers: DataFrame, run_id: str, kind: str) -> DataFrame:
    """Call-log rows for new answers (ANSWER) to requests (key, prompt)."""
    j = answers.join(requests.select("key", "prompt").dropDuplicates(["key"]), "key")
    return j.select(
        F.current_timestamp().alias("ts"), F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), "backend", "model", F.sha2("prompt", 256).alias("prompt_sha256"),
        F.length("prompt").cast("long").alias("prompt_chars"), "tokens", "attempts", F.col("error").isNull().alias("ok"), "error",
    )


def as_json(reply: Reply) -> str:
    return json.dumps(asdict(reply), ensure_ascii=False)
