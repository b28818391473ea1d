"""Similarities and judgments that a model gives: requests out of segments, replies back into the places they were asked for.

Cells of a pair's band go twenty to a request, made in the pair's own row, so
texts are moved once a pair.  A reply's scores are scattered back by (pair, batch,
i, j); a cell without a score is 0 and is counted.  Judgments keep all spans of a
reply that occur verbatim; an operation without an understood reply has a null
difference, which `score` answers with its fallback.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as T
from . import judge, model, similarity
from .stored import stored


_ASKED = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("a", pa.string()), ("b", pa.string())])
#: Bytes of texts that weigh as much as a cell.
CELL_BYTES = 128


def similarity_requests(segments: DataFrame, name: str, size: int = model.PAIRS_A_CALL, width: float = 0.2, near: int = 2) -> DataFrame:
    """(pair_id, lang, n, m, batch, cells, key, prompt): a row for each call of ``size`` cells; pairs without cells have one row without a prompt.

    Calls are cut from the pair's row a batch at a time, so all passages of a pair's cells are never in one row.
    """
    kind = segments.schema["pair_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in similarity.few(batches):
            texts, starts, longest = [], [], np.ones(part.num_rows, np.int64)
            for c in (2, 3):
                text = part.column(c).flatten().cast(pa.string())
                start = np.r_[0, np.cumsum(pc.list_value_length(part.column(c)).to_numpy(zero_copy_only=False).astype(np.int64))]
                long = pc.binary_length(text).to_numpy(zero_copy_only=False)
                longest += np.array([long[lo:hi].max(initial=0) for lo, hi in zip(start, start[1:], strict=False)], np.int64)
                texts.append(text)
                starts.append(start)

            def make(row: int, cells: tuple) -> list[pa.Array]:
                i, j = cells
                return [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[t.take(pa.array(s[row] + x)) for t, s, x in zip(texts, starts, cells, strict=True)]]  # noqa: B023

            sizes = [np.diff(s).tolist() for s in starts]
            pairs = ((k, n, m, similarity.band_stretches(n, m, width, near)) for k, (n, m) in enumerate(zip(*sizes, strict=True)))
            none = (np.empty(0, np.int64), np.empty(0, np.int64))
            for (row, *numbers), ends, held in similarity.in_rows(pairs, size, make, lambda k: 1 + int(longest[k]) // CELL_BYTES, none):  # noqa: B023
                asked = pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], fields=list(_ASKED))
                pick = pa.array(row)
                columns = [part.column(0).take(pick), part.column(1).take(pick), *[pa.array(x, pa.int32()) for x in numbers], pa.ListArray.from_arrays(ends, asked)]
                yield pa.RecordBatch.from_arrays(columns, ["pair_id", "lang", "n", "m", "batch", "asked"])

    rows = similarity.by_pair(segments).mapInArrow(run, f"pair_id {kind}, lang string, n int, m int, batch int, asked array<struct<i:int,j:int,a:string,b:string>>")
    prompt = F.when(F.size("asked") > 0, model.similarity_prompt(F.col("lang"), F.col("asked")))
    rows = rows.withColumn("prompt", prompt).withColumn("cells", F.transform("asked", lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"))))
    return rows.withColumn("key", F.when(F.col("prompt").isNotNull(), model.call_key(F.lit(name), F.col("prompt"), F.lit(0)))).drop("asked")


def similarity_batches(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(pair_id, lang, n, m, batch, cells, lost): ``requests`` with scores (i, j, score, sim) in the places they were asked for, from answers (key, text); ``lost`` cells have none."""
    told = answers.select("key", parsing.scored(F.col("text")).alias("scores"))
    j = requests.drop("prompt").join(told, "key", "left")

    def placed(c: Column) -> Column:
        own = F.filter(F.coalesce("scores", F.array().cast("array<struct<i:int,j:int,score:double>>")), lambda s: (s["i"] == c["i"]) & (s["j"] == c["j"]))
        return T.let(F.get(own, F.lit(0))["score"], lambda x: F.struct(c["i"].alias("i"), c["j"].alias("j"), x.alias("score"), F.when(x.isNotNull(), T.clamp01(x / 5)).otherwise(0.0).alias("sim")))

    scattered = j.withColumn("cells", F.transform("cells", placed))
    return scattered.select("pair_id", "lang", "n", "m", "batch", "cells", F.size(F.filter("cells", lambda c: c["score"].isNull())).alias("lost"))


def similarity_matrix(requests: DataFrame, answers: DataFrame) -> tuple[DataFrame, int]:
    """(`similarity.matrix` with cells (i, j, score, sim), number of cells without a score) from requests and answers (key, text).

    For steps that need a pair's cells in one row; others take `similarity_batches`.
    """
    in_order = F.sort_array(F.collect_list(F.struct("batch", "cells")))
    pairs = similarity_batches(requests, answers).groupBy("pair_id").agg(
        F.first("lang").alias("lang"), F.first("n").alias("n"), F.first("m").alias("m"), F.flatten(F.transform(in_order, lambda x: x["cells"])).alias("cells"), F.sum("lost").alias("lost")
    )
    kept = stored(pairs, "similarity")
    return kept.drop("lost"), kept.agg(F.coalesce(F.sum("lost"), F.lit(0))).first()[0]


def judge_requests(ops: DataFrame, segments: DataFrame, name: str) -> DataFrame:
    """Two-sided operations with their passages, key and prompt."""
    p = judge.passages(ops, segments)
    p = p.withColumn("prompt", model.judge_prompt(F.col("lang"), F.col("text_a"), F.col("text_b")))
    return p.withColumn("key", model.call_key(F.lit(name), F.col("prompt"), F.lit(0)))


def judgments(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The rows of ``requests`` with difference, spans_a, spans_b, ok and repairs from answers (key, text, repairs)."""
    j = requests.join(answers.select("key", F.col("text").alias("reply"), "repairs"), "key", "left")
    found = j.withColumn("_j", parsing.judged(F.col("reply"), F.col("text_a"), F.col("text_b")))
    none = F.array().cast("array<string>")
    spans = {f"spans_{s}": F.coalesce(f"_j.spans_{s}", none) for s in "ab"}
    known = F.col("_j.difference").isNotNull()
    return found.withColumns({"difference": F.col("_j.difference"), **spans, "ok": known, "repairs": F.coalesce("repairs", F.lit(0))}).drop("_j", "prompt")
