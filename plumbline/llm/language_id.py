"""Language identification by Bayesian fusion of several kinds of evidence.

For each row and language four terms are added: the log-likelihood of the text
under the language's byte-bigram model, the log-probability of the declared
language given the true one, and the log-prior of the row's host.  A host's
prior is its own counts smoothed towards its address suffix's, which are
smoothed towards those of all rows, so a host with few rows follows its suffix.

Languages are the declared values of the rows themselves, all of which ``min_rows``
rows or more declare (a row's own bigrams are left out when it is scored, so one
row alone teaches it nothing).  One more hypothesis, UNKNOWN, stands for every
other language and for noise: its model is the bigrams of all rows mixed with a
uniform one, so a text that fits no language better than it fits all of them is
not accepted.  A row's own bigrams are taken out of the models that learnt from
it before it is scored.

Models and counts come from all rows by grouped aggregation; what reaches the
driver is bounded by the declared values, a code list: the bigrams that occur
(65,536 at most) x languages as Arrow columns, declared x languages, and one
count for each language.

Defined cases: null text is empty; a row without letters has no text evidence
and is not accepted.  Null declared language, host or suffix are values of
their own.  Declared values that are no language here count as one value.
Repeated rows are judged each for itself; with no rows there is no result; with
no declared language everything is UNKNOWN.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

UNKNOWN = "und"
CODES = 1 << 16
#: Languages whose counts a task holds before it passes them on.
MOST_HELD = 128


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] | None = None  # None: from the declared values
    min_rows: int = 2
    uniform: float = 0.2  # share of the uniform model in UNKNOWN's
    smoothing: float = 0.5  # added to each bigram count
    text_weight: float = 0.25  # neighbouring bigrams tell much of the same
    host_weight: float = 20.0  # rows that a suffix's counts weigh in a host's prior
    suffix_weight: float = 50.0
    min_confidence: float = 0.5


def bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    return raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:]


def letters(text: str) -> int:
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    return int(np.count_nonzero((raw >= 97) & (raw <= 122) | (raw >= 128)))


def languages_of(rows: DataFrame, s: Settings) -> tuple[str, ...]:
    """The declared values that are languages, in order."""
    if s.languages is not None:
        return s.languages
    found = rows.filter("declared <> ''").groupBy("declared").count().filter(F.col("count") >= s.min_rows)
    return tuple(sorted(r["declared"] for r in found.collect()))  # a row a language


def train(rows: DataFrame, languages: tuple[str, ...], s: Settings) -> Counts:
    """Counts of bigrams by language, from all rows (text, declared)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        at = {x: k for k, x in enumerate(languages)}

        def add(by: dict[int, list[np.ndarray]]) -> None:
            for k, codes in by.items():
                total[k] = total.get(k, 0) + np.bincount(np.concatenate(codes), minlength=CODES)
            by.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for k, n in total.items():
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code.astype(np.int32)), pa.array(n[code])], ["k", "code", "n"])
            total.clear()

        for b in batches:
            by: dict[int, list[np.ndarray]] = {}
            held = 0
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if lang in at and (t := text.as_py()):
                    codes = bigrams(t)
                    by.setdefault(at[lang], []).append(codes)
                    held += len(codes)
                if held > 1 << 21:
                    add(by)
                    held = 0
            add(by)
            if len(total) > MOST_HELD:
                yield from told()
        yield from told()

    counted = rows.select("text", "declared").mapInArrow(count, "k int, code int, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    k, code, n = (found.column(c).to_numpy() for c in ("k", "code", "n"))
    codes, at = np.unique(code, return_inverse=True)
    table = np.zeros((len(codes), len(languages) + 1))
    table[at, k] = n
    table[:, -1] = table[:, :-1].sum(axis=1)
    return Counts(codes.astype(np.int64), table)


@dataclass
class Counts:
    """Bigrams that occur, ascending, and how often in each language, in the last column in all."""

    codes: np.ndarray
    table: np.ndarray

    def of(self, code: np.ndarray) -> np.ndarray:
        """The rows of some bigrams; zeros for those that do not occur."""
        if not len(self.codes):
            return np.zeros((len(code), self.table.shape[1]))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code)[:, None], self.table[at], 0.0)


class Model:
    """log P(second byte | first byte, language) from `train`'s counts; the last column is UNKNOWN's."""

    def __init__(self, counts: Counts, s: Settings):
        self.counts, self.s = counts, s
        self.firsts = np.zeros((256, counts.table.shape[1]))
        np.add.at(self.firsts, counts.codes >> 8, counts.table)
        self.logs = Counts(counts.codes, self._log(counts.table, self.firsts[counts.codes >> 8]))
        self.unseen = self._log(np.zeros_like(self.firsts), self.firsts)

    def _log(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        p = (n + self.s.smoothing) / (of + 256 * self.s.smoothing)
        p[:, -1] = (1 - self.s.uniform) * p[:, -1] + self.s.uniform / 256
        return np.log(p)

    def score(self, codes: np.ndarray, own: int | None) -> np.ndarray:
        """Log-likelihood of bigrams under each language; ``own``: the language that learnt from them."""
        code, n = np.unique(codes, return_counts=True)
        code = code.astype(np.int64)
        first = code >> 8
        logs = self.logs.of(code)
        logs = np.where((logs == 0).all(axis=1)[:, None], self.unseen[first], logs)  # the log of a bigram that occurs is below 0
        if own is not None:
            mine = [own, -1]
            logs[:, mine] = self._log(self.counts.of(code)[:, mine] - n[:, None], (self.firsts[:, mine] - np.bincount(first, n, 256)[:, None])[first])
        return n @ logs


def text_evidence(rows: DataFrame, languages: tuple[str, ...], table: Counts, s: Settings) -> DataFrame:
    """(key, digest, declared, host, suffix, letters, evidence): evidence is each language's weighted log-likelihood, best at 0."""

    at, width = {x: k for k, x in enumerate(languages)}, len(languages) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(table, s)
        for b in batches:
            evidence, n = [], []
            for text, declared in zip(b.column("text"), b.column("declared").to_pylist(), strict=True):
                t = text.as_py() or ""
                n.append(letters(t))
                ll = model.score(bigrams(t), at.get(declared))
                evidence.append((s.text_weight * (ll - ll.max())).tolist() if n[-1] else [0.0] * width)
            keep = [b.column(c) for c in ("key", "digest", "declared", "host", "suffix")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(evidence, pa.list_(pa.float64()))], ["key", "digest", "declared", "host", "suffix", "letters", "evidence"])

    return rows.mapInArrow(run, "key long, digest long, declared string, host string, suffix string, letters long, evidence array<double>")


def _counts(best: Column, width: int) -> Column:
    """Rows by best language, as an array."""
    return F.array(*[F.count_if(best == k + 1).cast("double") for k in range(width)])


def _smooth(own: Column, wider: Column, weight: float) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, wider, lambda n, p: (n + weight * p) / (total + weight))


def identify(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For rows (key, text, declared, host, suffix): key, digest of the text, lang, confidence, text_lang, declared, accepted."""
    languages = languages_of(rows, s)
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNull(), "").otherwise("other")
    rows = rows.select(
        "key", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text", known.alias("declared"),
        F.coalesce("host", F.lit("\x00")).alias("host"), F.coalesce("suffix", F.lit("\x00")).alias("suffix"),
    )
    table = train(rows, languages, s)
    seen = store(text_evidence(rows, languages, table, s), "language-evidence")
    seen = seen.withColumn("best", F.when(F.col("letters") > 0, F.array_position("evidence", F.array_max("evidence"))))
    names = [*languages, UNKNOWN]
    width = len(names)
    declared_as: dict[str, list[float]] = {d: [1.0] * width for d in (*languages, "other", "")}
    for r in seen.filter("best is not null").groupBy("declared", "best").count().collect():  # declared values x languages
        declared_as[r["declared"]][r["best"] - 1] += r["count"]
    by_lang = [sum(v[k] for v in declared_as.values()) for k in range(width)]
    told = F.create_map(*[x for d, v in declared_as.items() for x in (F.lit(d), F.array(*[F.lit(math.log(v[k] / by_lang[k])) for k in range(width)]))])
    overall = F.array(*[F.lit(x / sum(by_lang)) for x in by_lang])
    hosts = seen.groupBy("host", "suffix").agg(_counts(F.col("best"), width).alias("n"))
    sums = [F.sum(F.get("n", k)) for k in range(width)]
    suffixes = store(hosts.groupBy("suffix").agg(F.array(*sums).alias("of_suffix")), "language-suffixes")
    priors = hosts.join(suffixes, "suffix").select("host", "suffix", _smooth(F.col("n"), _smooth(F.col("of_suffix"), overall, s.suffix_weight), s.host_weight).alias("prior"))
    joined = seen.join(store(priors, "language-priors"), ["host", "suffix"])
    fused = F.zip_with(F.zip_with("evidence", "prior", lambda e, p: e + F.log(p)), F.element_at(told, F.col("declared")), lambda a, b: a + b)
    joined = joined.withColumn("fused", fused)
    top = F.array_max("fused")
    names = F.array(*map(F.lit, names))
    joined = joined.withColumn("confidence", 1.0 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return joined.select(
        "key",
        "digest",
        F.element_at(names, F.array_position("fused", top).cast("int")).alias("lang"),
        "confidence",
        F.get(names, F.col("best").cast("int") - 1).alias("text_lang"),
        F.nullif("declared", F.lit("")).alias("declared"),
        ((F.col("letters") > 0) & (F.col("confidence") >= s.min_confidence) & (F.array_position("fused", top) < width)).alias("accepted"),
    )


_ADDRESS = r"[a-zA-Z]+://([^/:?#\s\"'<>]+)"
_MARKUP = r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})"


def _suffix(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Documents have a source for host; markup in the text declares a language before the column does, and the first address in it tells a suffix."""
    text = F.coalesce("text", F.lit(""))
    marked = F.when(F.contains(text, F.lit("<")), F.nullif(F.lower(F.regexp_extract(text, _MARKUP, 1)), F.lit("")))
    suffix = F.when(F.contains(text, F.lit("://")), _suffix(F.lower(F.regexp_extract(text, _ADDRESS, 1))))
    return docs.select(F.col("doc_id").cast("long").alias("key"), "text", F.coalesce(marked, F.col("lang")).alias("declared"), F.col("source").alias("host"), suffix.alias("suffix"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Pages: the text between tags, the language of the html element, the host and its last label."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", _MARKUP, 1))
    return pages.select(
        F.col("page_id").cast("long").alias("key"), bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"), _suffix(host).alias("suffix"),
    )


def keep(docs: DataFrame, s: Settings = Settings(), broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` (documents) that are accepted, whole.

    Rejected rows are told by doc_id and a digest of the text; up to
    ``broadcast_rows`` of them (counted first) go to every task, more are
    joined by a shuffle.
    """
    gone = store(identify(evidence_of_documents(docs), s).filter(~F.col("accepted")).select(F.col("key").alias("_key"), F.col("digest").alias("_digest")).distinct(), "language-rejected")
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    return rows.join(gone, same, "left_anti").select("row.*")
