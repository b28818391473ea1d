"""Document fingerprints: canonical exact digests (native DataFrame functions only).

Canonical text: Unicode NFKC, full case folding, NFKC again, every run of white
space as one space, none at the ends.  The JVM's own ICU library does it,
called by the SQL function ``reflect``; plain ASCII takes ``lower``, which gives
the same.  The digest is two 64-bit xxHashes of different seed.  Equal digests
are confirmed: documents are grouped by digest *and* canonical text, so texts
are compared byte by byte inside a bucket, with partial sums before the
shuffle; should a bucket hold two texts, their digests get a suffix.

Defined cases: null text is the empty text.  The next document is the next
lower doc_id (ties, and null ids, which come last: by the text's hash, descending);
after the last comes the first.  A single document is its own next.  Repeated rows
keep a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, store

#: Runs of neighbouring ids that one window sorts: about so many a shuffle partition, and so many at most.
RUNS_PER_PARTITION, MOST_RUNS = 4, 1 << 14
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Canonical text of a text that is not null."""

    def icu(cls: str, method: str, value: Column) -> Column:
        return F.call_function("reflect", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), value, F.lit(True))

    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", icu("text.Normalizer", "compose", text)))
    one = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(one, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def digest(value: Column) -> Column:
    """128 bits as 32 hexadecimal digits; the second half is hashed from another seed."""
    halves = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(value), F.xxhash64(F.lit("second"), value))]
    return F.concat(*halves)


def _few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (stored, short rows) marked for broadcast if it has been counted to hold few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("h"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, fp, sha) for every row: hash of the text, digest and SHA-256 of its canonical text, made once and stored."""
    c = _texts(docs, key, text).withColumn("c", canonical(F.col("t")))
    return store(c.select("doc_id", "h", digest(F.col("c")).alias("fp"), F.sha2("c", 256).alias("sha")), "fingerprint-digests")


def groups(docs: DataFrame, made: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each digest of ``made`` (from `digests`): fp, n_docs, group_id (smallest key), n_texts (different canonical texts in it).

    Canonical texts are made again, and compared as bytes, only for buckets with more than one document.
    """
    buckets = store(made.groupBy("fp").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n_docs")), "fingerprint-buckets")
    several = store(buckets.filter("n_docs > 1").select("fp"), "fingerprint-several")
    shared = store(made.join(_few(several), "fp", "left_semi").select("doc_id", "h", "fp").distinct(), "fingerprint-shared")
    rows = _texts(docs, key, text).alias("d").join(_few(shared).alias("s"), _same("d", "s"))
    same = rows.select("s.fp", canonical(F.col("d.t")).alias("c")).groupBy("fp", "c").agg(F.count(F.lit(1)).alias("n"))
    clash = same.groupBy("fp").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    return buckets.join(clash, "fp", "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(1)))


def _run_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``, by two short scans."""
    wide = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    if not parts:
        return F.lit(0)
    part = upto(F.array(*[F.lit(p[0]) for p in parts]))
    fine = upto(F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part - 1))
    return F.when(part > 0, (part - 1) * wide + fine).otherwise(F.lit(0))


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id long, t, h) with struct ``next`` (doc_id, t, h) of the next row, by descending doc_id.

    Runs of neighbouring ids, cut at quantiles, are sorted by a window each: one
    shuffle of the texts.  The first row of each run is read again, for the
    last of the run above it; the single-task window sees one row a run.
    """
    many = min(MOST_RUNS, RUNS_PER_PARTITION * partitions(rows.sparkSession))
    shares = [k / many for k in range(1, many)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * many)).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    # null ids come after all others; they are cut by the leading bits of the hash
    run = F.when(F.col("doc_id").isNull(), F.shiftright("h", 48).cast("int") - (1 << 20)).otherwise(_run_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("run", run)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("t").desc()]
    led = rows.withColumn("next", F.lead(F.struct("doc_id", "t", "h")).over(Window.partitionBy("run").orderBy(*order)))
    # the first row of a run: largest id, then largest hash
    tops = store(rows.groupBy("run").agg(F.max(F.struct("doc_id", "h")).alias("top")).select("run", "top.doc_id", "top.h"), "fingerprint-tops")
    firsts = rows.alias("r").join(F.broadcast(tops).alias("s"), _same("r", "s")).groupBy("r.run").agg(F.max(F.struct("r.doc_id", "r.t", "r.h")).alias("first"))
    firsts = store(firsts, "fingerprint-firsts")  # a row for each of at most MOST_RUNS runs and 65,536 of null ids
    by = Window.orderBy(F.col("run").desc())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("run", F.coalesce(F.lead("run").over(by), F.first("run").over(whole)).alias("after"))
    heads = after.join(firsts.withColumnRenamed("run", "after"), "after").select(F.col("run").alias("head_run"), F.col("first").alias("head"))
    joined = led.join(heads, (F.col("run") == F.col("head_run")) & F.col("next").isNull(), "left")
    return joined.select("doc_id", "t", "h", F.coalesce("next", "head").alias("next"))


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how alike they and the next document's are.

    Canonical text is made once for each text and once for each edited text;
    fingerprints of neighbours are joined by id and text hash.
    """
    made = digests(docs, key, text)
    led = with_next(_texts(docs, key, text))
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.expr("left(t, length(t) - cast(floor(length(t) / 2) as int))"), F.substring("next.t", F.lit(1), half))
    d = led.select("doc_id", "h", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"), F.length("t").cast("long").alias("n_chars"), edited.alias("e"))
    d = d.select("doc_id", "h", "next_id", "next_h", "n_chars", F.sha2("e", 256).alias("edited_sha256"), canonical(F.col("e")).alias("c"))
    d = store(d.select("*", digest(F.col("c")).alias("edited_fp"), F.sha2("c", 256).alias("edited_sha")).drop("c"), "fingerprint-edited")
    g = store(groups(docs, made, key, text), "fingerprint-groups")
    clash = store(g.filter("n_texts > 1").select(F.col("fp").alias("clash_fp")), "fingerprint-clashes")

    def whole(rows: DataFrame, fp: str, sha: str) -> DataFrame:
        """Digests of buckets with several texts get the text's SHA-256."""
        found = rows.join(_few(clash), F.col(fp) == F.col("clash_fp"), "left")
        return found.withColumn(fp, F.when(F.col("clash_fp").isNotNull(), F.concat(fp, F.lit("-"), sha)).otherwise(F.col(fp))).drop("clash_fp")

    known = made.distinct().join(g, "fp")
    known = store(whole(known, "fp", "sha").select("doc_id", "h", "fp", "group_id", "n_docs"), "fingerprint-known")
    own = whole(d, "edited_fp", "edited_sha").alias("d").join(known.alias("k"), _same("d", "k"))
    both = own.join(known.alias("n"), F.col("d.next_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.next_h") == F.col("n.h")))
    alike = lambda a, b: F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))
    return both.select(
        "d.doc_id",
        "d.n_chars",
        "d.edited_sha256",
        F.col("k.fp").alias("fingerprint"),
        F.col("d.edited_fp").alias("edited_fingerprint"),
        alike("k.fp", "d.edited_fp").alias("near_edited"),
        alike("k.fp", "n.fp").alias("near_next"),
        "k.group_id",
        F.col("k.n_docs").alias("group_size"),
    )
