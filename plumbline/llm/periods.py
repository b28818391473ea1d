"""Periodic runs of words: harmonic grid probing.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are equal), at least ``min_length`` words and ``min_exponent`` periods
long, that no neighbouring word extends.  A run of period p covers at least
``min_exponent`` grid points jp, so word jp equals word (j + 1)p and word
(j + 2)p there; over all p that is n ln n probes, made in array operations.
Grid points that pass are probed at a few more places between them, then
extended to both sides by chunked array comparison.  Grid points that lie, one
period wide, within a stretch already found for a divisor of p are skipped:
all that they could find is that stretch again (two stretches of one period
that overlap by a period are one).

Every text is handled by itself, whole, in the task that reads it: no shuffle,
and memory in proportion to one text and PROBES.

Defined cases: a null or empty text has no words and no runs.  Repeated rows
keep a row each.  Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most probes held at once.
PROBES = 1 << 18
#: Rows of a text batch that is passed on.
ROWS = 256
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Words = list[bytes]


def _matches(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many places at, at + step, at + 2 * step, ... in a row hold the word that stands p later."""
    n, size = 0, 32
    last = len(w) - p  # places from here on have nothing p later
    while True:
        lo, hi = (at + n, min(at + n + size, last)) if step > 0 else (max(at - n - size + 1, 0), at - n + 1)
        if lo >= hi:
            return n
        same = (w[lo:hi] == w[lo + p : hi + p])[::step]
        if not same.all():
            return n + int(same.argmin())
        n, size = n + hi - lo, min(2 * size, 1 << 16)


def _survivors(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, grid point) for periods low..high-1 where three grid points in a row, and places between, agree."""
    n = len(w)
    periods = np.arange(low, high)
    counts = (n - 1) // periods  # gaps between grid points
    p = np.repeat(periods, counts)
    left = (np.arange(len(p)) - np.repeat(np.cumsum(counts) - counts, counts)) * p
    equal = w[left] == w[left + p]
    ok = np.flatnonzero(equal[:-1] & equal[1:] & (p[:-1] == p[1:]))
    p, left = p[ok], left[ok]
    for share in (2, 4, 8, 3):
        if not len(p):
            break
        at = left + np.maximum(1, p // share)
        ok = w[at] == w[at + p]
        p, left = p[ok], left[ok]
    return p, left


def find_runs(w: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``w``, by start, then period."""
    if min_exponent < 3:
        raise ValueError("three grid points in a row need runs of three periods or more")
    n = len(w)
    found: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends of stretches, ascending
    runs: list[tuple[int, int, int]] = []
    most = n // min_exponent if n >= min_length else 0
    low = 1
    while low <= most:
        high = low + 1
        if low * PROBES > n:  # as many periods as PROBES allows, counted at the densest
            high = min(most + 1, low + max(1, PROBES * low // n))
        ps, lefts = _survivors(w, low, high)
        low = high
        cuts = np.flatnonzero(np.r_[True, ps[1:] != ps[:-1]]) if len(ps) else ps
        for p, left in zip(ps[cuts].tolist(), np.split(lefts, cuts[1:]) if len(cuts) else [], strict=True):
            for q, (starts, ends) in found.items():
                if p % q == 0 and len(left):
                    k = np.searchsorted(starts, left, "right") - 1
                    left = left[(k < 0) | (left + p > np.asarray(ends)[k])]
            at, own = 0, ([], [])
            while at < len(left):
                x = int(left[at])
                start = x - _matches(w, x - 1, p, -1) if x else 0
                end = x + _matches(w, x, p, 1) + p
                if end - start >= 2 * p:
                    own[0].append(start)
                    own[1].append(end)
                if end - start >= max(min_length, min_exponent * p):
                    runs.append((start, end - start, p))
                at = max(at + 1, int(np.searchsorted(left, end - p, "right")))
            if own[0]:
                found[p] = own
    return sorted(runs, key=lambda r: (r[0], r[2]))


def number_words(words: Words) -> np.ndarray:
    """Equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), np.int64, len(words))


def collapse(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [x for x, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 24, min_exponent: int = 3, rewrite: Callable[[int | None, Words], Words] | None = None
) -> DataFrame:
    """(key, n_words, runs, strongest, collapsed) for every row.

    ``runs`` are structs of start, length and period in words; ``strongest`` is
    the one of greatest length / period (ties: smallest start, then period), null
    without runs; ``collapsed`` is the text's words, one space between them,
    without the repeats.  ``rewrite`` maps a row's key and words to the words to
    work on.
    """
    schema = f"{key} long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                sizes, all_runs, best, kept = [], [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    words = (t.as_py() or "").encode().split()
                    if rewrite:
                        words = rewrite(k, words)
                    runs = find_runs(number_words(words), min_length, min_exponent)
                    named = [{"start": s, "length": n, "period": p} for s, n, p in runs]
                    sizes.append(len(words))
                    all_runs.append(named)
                    best.append(max(named, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
                    kept.append(b" ".join(collapse(words, runs)).decode())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, RUNS), pa.array(best, RUNS.value_type), pa.array(kept, pa.string())], [key, "n_words", "runs", "strongest", "collapsed"]
                )

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(run, schema)


def describe(runs: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
