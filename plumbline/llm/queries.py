"""The queries of this subpackage and, where SQL can say it, what they must return."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprint, grid_join, language_id, packing, periods, ppm, quality, sharding, simhash, spelling, wavelet
from .common import documents, new_folder
from .tokens import tokenizer_path

ARRIVALS = 4
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in ARRIVALS parts, each appended as small shards; compaction after every second one; every row is read back with its shard."""
    shards = sharding.ShardStore(spark, new_folder(spark, "shards"))
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    for k in range(ARRIVALS):
        shards.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))  # the parts make up the whole table
        if k % 2:
            shards.compact()
            shards.vacuum(min_age_s=0)  # nobody else writes to this new folder
    return shards.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars", "shard")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return d.select(
        "doc_id",
        F.col("q_m.w.n_words").alias("n_words"),
        F.col("q_m.w.word_chars").alias("word_chars"),
        F.col("q_m.s").alias("n_symbols"),
        F.col("q_m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("q_m.w.n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bpe.encoded(docs, tokenizer_path(BYTE_BPE), bpe.sha256_pair, "ids_sha256 string, decoded_sha256 string")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = language_id.identify(language_id.evidence_of_documents(documents(spark, sf_dir, "doc_id", "text", "lang", "source")))
    return d.select(F.col("key").alias("doc_id"), "lang", "confidence", "text_lang", "declared", "accepted")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over pages, which have markup and addresses."""
    d = language_id.identify(language_id.evidence_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return d.select(F.col("key").alias("page_id"), "lang", "confidence", "text_lang", "declared", "accepted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), shingle=4, distance=4)
    return d.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(BYTE_BPE))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(documents(spark, sf_dir, "doc_id", "text"), ppm.held_out(F.col("doc_id")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(WORD_BPE))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(documents(spark, sf_dir, "doc_id", "text"))


def op11_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def _planted_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's text: in a tenth of the documents the words from place a on repeat with period p."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periods.periodic_runs(documents(spark, sf_dir, "doc_id", "text"), rewrite=_planted_run)
    best = F.col("strongest")
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(periods.describe(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return spelling.group_variants(spelling.word_counts(docs, word=spelling.edited_word(F.col("doc_id"), 97)))


QUERIES = (
    op1_sharding,
    op2_quality_rules,
    op3_bpe,
    op4_language_id,
    op5_simhash_near_dedup,
    op6_token_shards,
    op7_chat_formatting,
    op8_ppm_scores,
    op9_best_fit_packing,
    op10_fingerprints,
    op11_grid_join,
    op12_periodic_runs,
    op13_spelling_variants,
    pages_language_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_WORD = "[^\\x20\\x09-\\x0D]"


def _quality_sql(rules: quality.Rules = quality.Rules()) -> str:
    """Counts, sketches by language and source, shrunk quantiles, limits and verdicts, as one statement."""
    bucket = "CASE WHEN v < 128 THEN v ELSE (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) END"
    cut = ", ".join(f"min(b) FILTER (upto >= ceil(total * {p}::DOUBLE)) AS {c}" for c, p in zip(("lo", "mid", "hi"), rules.quartiles, strict=True))
    level = lambda name, keys: f"""{name} AS (SELECT {keys}metric, any_value(total) AS total, {cut}
  FROM (SELECT {keys}metric, b, sum(n) OVER (PARTITION BY {keys}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS total
    FROM (SELECT {keys}metric, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY {keys}metric)"""  # noqa: E731
    level_sql = ",\n".join(level(n, k) for n, k in (("own", "lang, source, "), ("by_lang", "lang, "), ("by_all", "")))
    shrunk = lambda n, a, b: ", ".join(f"({n}.total::DOUBLE * {n}.{c} + {rules.weight} * {b}.{c}) / ({n}.total::DOUBLE + {rules.weight}) AS {c}" for c in ("lo", "mid", "hi"))
    usual = ", ".join(f"{rules.spread}::DOUBLE * (q[{k + 1}].hi + {rules.least[k]})" for k in range(4))
    counts = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_top", "n_words"))
    inside = " AND ".join(
        f"sqrt({c} / {rules.clump[k]}::DOUBLE) <= sqrt({n} * lim[{k + 1}] / {quality.PPM * rules.clump[k]}::DOUBLE) + {rules.slack}::DOUBLE" for k, (c, n) in enumerate(counts)
    )
    return f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, lang, source, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM twice) GROUP BY doc_id),
tops AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, u, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS u FROM w) WHERE length(u) >= 4 GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_top FROM w LEFT JOIN repeats r USING (doc_id) LEFT JOIN tops x USING (doc_id)),
rated AS (SELECT *, [n_symbols * 1000000 // greatest(word_chars, 1), n_dup_lines * 1000000 // greatest(n_lines, 1), n_repeat_words * 1000000 // greatest(n_words, 1),
  n_top * 1000000 // greatest(n_words, 1), word_chars * 1000 // greatest(n_words, 1)]::BIGINT[] AS rates, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM m),
sketch AS (SELECT lang, source, metric, {bucket} AS b, count(*) AS n FROM (SELECT lang, source, unnest(rates) AS v, unnest(range(5)) AS metric FROM rated WHERE NOT base_failed) GROUP BY ALL),
{level_sql},
of_lang AS (SELECT l.lang, l.metric, {shrunk("l", "l", "a")} FROM by_lang l JOIN by_all a USING (metric)),
of_own AS (SELECT o.lang, o.source, o.metric, {shrunk("o", "o", "l")} FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric),
limits AS (SELECT lang, source, [{usual}, q[5].mid, {rules.len_spread}::DOUBLE * (q[5].hi - q[5].lo + {rules.len_least})] AS lim
  FROM (SELECT lang, source, list({{'lo': lo, 'mid': mid, 'hi': hi}} ORDER BY metric) AS q FROM of_own GROUP BY lang, source)),
judged AS (SELECT r.*, lim FROM rated r LEFT JOIN limits l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {inside} AND abs(rates[5] - lim[5]) <= lim[6] + {rules.len_short}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE), false) AS kept FROM judged"""


def _chat_sql() -> str:
    """Conversations as the texts of their prefixes; those that are a proper prefix of another go, of equal ones the first stays."""
    return """WITH r AS (SELECT conv_id, turn // 1024 AS part, role, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM r),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY prefix),
best AS (SELECT conv_id, n_copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT r.conv_id, part, any_value(n) AS n_turns, any_value(n_copies) AS n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered FROM r JOIN best USING (conv_id) GROUP BY r.conv_id, part"""


def _join_sql(cosine: float = 0.93) -> str:
    """Every pair of a label, and what each vector reaches."""
    norm = lambda x: f"sqrt(list_dot_product({x}, {x}))"
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / {norm('a.e')} / {norm('b.e')} >= {cosine}::DOUBLE),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON p.a = reach.r),
low AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""


#: The table of byte steps of crc32, made by its rule, and the crc32 of a list of bytes.
_CRC_TABLE = """steps AS (SELECT list(c ORDER BY i) AS tab FROM
  (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) t(i)))"""


def _crc_sql(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295)"


_KEY_OCTETS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"


def _runs_sql() -> str:
    """Stretches of equal eight-word windows p apart, without those that a stretch of a divisor of p holds."""
    return f"""WITH {_CRC_TABLE},
docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws, {_crc_sql(_KEY_OCTETS)} AS h FROM documents, steps),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM (SELECT *, len(ws) AS n, h // 10 AS g FROM docs)),
texts AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) END AS w FROM placed),
windows AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 8], ' ') AS x FROM (SELECT *, unnest(range(n - 7)) AS i FROM texts WHERE n >= 24)),
twins AS (SELECT a.doc_id, a.i, b.i - a.i AS p FROM windows a JOIN windows b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i - a.i <= a.n // 3),
stretches AS (SELECT doc_id, p, min(i) AS s, count(*) + 7 + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS block FROM twins) GROUP BY doc_id, p, block),
long AS (SELECT * FROM stretches WHERE l >= greatest(24, 3 * p)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.doc_id = x.doc_id AND y.p < x.p AND x.p % y.p = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
best AS (SELECT doc_id, s, l, p FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / p::DOUBLE DESC, s, p) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM runs GROUP BY doc_id),
dropped AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + p, s + l)) AS i FROM runs) GROUP BY doc_id),
kept AS (SELECT t.doc_id, CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)), ' ') END AS t FROM texts t LEFT JOIN dropped USING (doc_id))
SELECT k.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, p::BIGINT AS period, (1000 * l // p)::BIGINT AS exponent_milli,
  sha256(coalesce(e.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256 FROM kept k LEFT JOIN best USING (doc_id) LEFT JOIN listed e USING (doc_id)"""


def _spelling_sql() -> str:
    """Near words as pairs, which a table of this size can bear; forms by rank, roots by walking."""
    letters = "list_transform(string_split(run, ''), lambda c: ord(c)::BIGINT)"
    octets = f"flatten(list_transform({letters}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))"
    return f"""WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc_sql(f"list_concat({_KEY_OCTETS}, [58], {octets})")} AS h FROM found, steps),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
open_at AS (SELECT word, unnest(range(length(word))) AS i FROM v),
wild AS (SELECT word, i, left(word, i) AS l, substr(word, i + 2) AS r FROM open_at),
near AS (SELECT a.word, b.word AS other FROM wild a JOIN wild b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT w.word, v.word FROM wild w JOIN v ON v.word = w.l || w.r UNION SELECT v.word, w.word FROM wild w JOIN v ON v.word = w.l || w.r),
counts AS (SELECT word, count(*) AS n_near FROM near GROUP BY word),
best AS (SELECT near.word, other, v.n FROM near JOIN v ON v.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) = 1),
forms AS (SELECT v.word, other AS form, best.n AS form_n FROM v JOIN best USING (word) WHERE best.n >= 2 * v.n),
walk AS (SELECT word, form AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root),
roots AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM forms))
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM v LEFT JOIN counts USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": _quality_sql(),
        "op7_chat_formatting": _chat_sql(),
        "op11_grid_join": _join_sql(),
        "op12_periodic_runs": _runs_sql(),
        "op13_spelling_variants": _spelling_sql(),
    }
