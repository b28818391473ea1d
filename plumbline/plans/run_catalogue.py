"""Queries of replies, calls, runs and reports, each with its SQL.

Replies, outcomes and calls are made from the tables' ids by a rule, so that SQL
can say what has to come out of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as T
from ..operators import baseline, lifecycle, model, pairs, report, runner, runs, score
from ..operators.stored import shared_folder
from ..streaming import scoring
from . import oracle
from .catalogue import Pipeline, _gold, _predictions, _r, _read, _table, query

SQL: dict[str, str] = {}
_ID = "cast(doc_id as string)"


def says(sql: str):
    """Registers a query with the SQL that returns the same."""

    def keep(f):
        SQL[f.__name__] = sql
        return query(f)

    return keep


@says("SELECT doc_id, CASE WHEN d <= 5 THEN d ELSE -1 END::INT AS difference, CASE WHEN d <= 5 THEN 'w' || doc_id END AS span_a FROM (SELECT doc_id, round_even(doc_id % 8 + 0.5, 0) AS d FROM labels)")
def reply_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Fenced replies with half points, out-of-range points and a span that is not in the text."""
    level = (F.col("doc_id") % 8).cast("string")
    reply = F.concat(F.lit('Sure:\n```json\n{"semantic_difference": '), level, F.lit('.5, "differing_spans": {"side_a": ["w'), F.expr(_ID), F.lit('", "zzz"], "side_b": []}}\n```'))
    j = parsing.judged(reply, F.concat(F.lit("alpha w"), F.expr(_ID)), F.lit("beta"))
    return _table(spark, sf, "labels").select("doc_id", j.alias("j")).select("doc_id", F.coalesce("j.difference", F.lit(-1)).alias("difference"), F.array_join("j.spans_a", " ").alias("span_a"))


@says("SELECT doc_id, 0 AS i, (doc_id % 3)::INT AS j, toxic::DOUBLE AS score FROM labels")
def reply_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal cells the last counts; entries out of shape are passed over."""
    at = (F.col("doc_id") % 3).cast("string")
    one = lambda v: F.concat(F.lit('{"i": 0, "j": '), at, F.lit(', "score": '), F.col(v).cast("string"), F.lit("}"))
    reply = F.concat(F.lit('{"scores": ['), one("quality"), F.lit(', {"i": "x"}, 7, '), one("toxic"), F.lit("]} as asked"))
    return _table(spark, sf, "labels").select("doc_id", F.explode(parsing.scored(reply)).alias("s")).select("doc_id", "s.i", "s.j", "s.score")


@says("SELECT doc_id, '{\"n\": ' || doc_id || ', \"s\": \"}{\"}' AS found FROM labels WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, NULL FROM labels WHERE doc_id % 4 = 3")
def reply_first_json(spark: SparkSession, sf: str) -> DataFrame:
    """The first object, with braces in its texts; none where it is cut off."""
    whole = F.concat(F.lit('so: {"s": "}{", "n": '), F.expr(_ID), F.lit('} and {"n": 0}'))
    reply = F.when(F.col("doc_id") % 4 == 3, F.lit('{"n": 1')).otherwise(whole)
    return _table(spark, sf, "labels").select("doc_id", parsing.object_text(reply).alias("found"))


@says("SELECT doc_id, 'a' || doc_id AS token, 3::DOUBLE AS label FROM labels UNION ALL SELECT doc_id, 'b [', 2.5 FROM labels")
def salvage_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """What can be read of a broken reply's first section."""
    reply = F.concat(F.lit('{"sentence1": [["a'), F.expr(_ID), F.lit('", 3], ["b [", "2.5"], ["c", true], ["d", ], "sentence2": [["e", 1]'))
    return _table(spark, sf, "labels").select("doc_id", F.explode(parsing.salvaged("sentence1")(reply)).alias("p")).select("doc_id", "p.token", "p.label")


@says("SELECT doc_id, idx::INT AS idx, CASE WHEN idx % 5 = 2 THEN 5 ELSE idx % 4 END::DOUBLE AS label FROM (SELECT doc_id, unnest(range(n_chars % 40 + 1)) AS idx FROM documents)")
def label_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Entries in order, every fifth token passed over."""
    d = _table(spark, sf, "documents").select("doc_id", F.sequence(F.lit(0), (F.col("n_chars") % 40).cast("int")).alias("at"))
    entry = lambda k: F.concat(F.lit('["t'), k.cast("string"), F.lit('", '), (k % 4).cast("string"), F.lit("]"))
    reply = F.concat(F.lit('{"sentence1": ['), F.array_join(F.transform(F.filter("at", lambda k: k % 5 != 2), entry), ", "), F.lit("]}"))
    labels = parsing.label_walker()(F.transform("at", lambda k: F.concat(F.lit("t"), k.cast("string"))), reply, "sentence1")
    return d.select("doc_id", F.posexplode(labels).alias("idx", "label"))


class _Echo:
    """Says the prompt again; odd prompts are understood only after a complaint."""

    def complete(self, messages, max_tokens, temperature, seed):
        prompt = messages[0]["content"]
        text = "what?" if prompt[-1] in "13579" and len(messages) == 1 else "R:" + prompt
        return model.estimated(model.Reply(text), prompt)


@says("SELECT doc_id AS n, 'R:' || lang || source AS text, source = 'src0' AS cached FROM documents")
def memo_invoke(spark: SparkSession, sf: str) -> DataFrame:
    """Requests answered from the memory, the rest by one call for each key."""
    prompt = F.concat("lang", "source")
    d = _table(spark, sf, "documents").select(F.col("doc_id").alias("n"), runs.content_key(F.col("lang"), F.col("source")).alias("key"), prompt.alias("prompt"), "source")
    cache = d.filter("source = 'src0'").select("key", F.concat(F.lit("R:"), "prompt").alias("text"), F.lit("m").alias("model"), F.lit("b").alias("backend"))
    found, _, _ = model.invoke(d.drop("source"), cache, lambda r: model.answered(r, _Echo, lambda text: text.startswith("R:")))
    return found.select("n", "text", "cached")


@says("SELECT doc_id, 'R:p' || doc_id AS text, (doc_id % 2)::INT AS repairs, (1 + doc_id % 2)::INT AS attempts, (length('p' || doc_id) // 4 + length('R:p' || doc_id) // 4)::BIGINT AS tokens FROM labels")
def judge_repairs(spark: SparkSession, sf: str) -> DataFrame:
    r = _table(spark, sf, "labels").select(F.expr(_ID).alias("key"), F.concat(F.lit("p"), F.expr(_ID)).alias("prompt"))
    return model.answered(r, _Echo, lambda text: text.startswith("R:")).select(F.col("key").cast("long").alias("doc_id"), "text", "repairs", "attempts", "tokens")


@says(f"WITH {oracle.DOCS} SELECT pair_id, 'judge' AS kind, sha256(text_a) AS sha_a, sha256(text_b) AS sha_b, CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS language FROM pair_docs")
def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt's request, taken out of it again, holds both passages unchanged."""
    prompt = model.judge_prompt(F.col("lang"), F.col("text_a"), F.col("text_b"))
    d = pairs.pair_docs(spark, sf).select("pair_id", prompt.alias("prompt"), F.from_json(model.request_of(prompt), "kind string, side_a string, side_b string").alias("r"))
    return d.select("pair_id", "r.kind", F.sha2("r.side_a", 256).alias("sha_a"), F.sha2("r.side_b", 256).alias("sha_b"), F.regexp_extract("prompt", r"and the (\w+) passage", 1).alias("language"))


@says("SELECT doc_id, 2 * (n_chars % 7) >= n_chars % 11 AND 2 * (n_chars % 5) >= n_chars % 13 AS complete FROM documents")
def reply_complete(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: F.col("n_chars") % k
    return _table(spark, sf, "documents").select("doc_id", model.is_complete(n(7), n(5), n(11), n(13)).alias("complete"))


@says("SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), ' ') AS sentence FROM conversations")
def token_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select("conv_id", "turn", model.sentence(T.split_words(F.col("text"))).alias("sentence"))


@says("SELECT doc_id, CASE WHEN quality - toxic >= 0 THEN least(1, quality * 1.5 - toxic)::DOUBLE END AS heat FROM labels")
def heat_colors(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("quality") - F.col("toxic") >= 0, F.col("quality") * 1.5 - F.col("toxic")).otherwise(-1.0)
    return _table(spark, sf, "labels").select("doc_id", lifecycle.heat(value).cast("double").alias("heat"))


@says("SELECT conv_id, turn, length(text) % 3 = 0 AS failed, CASE WHEN length(text) % 3 = 0 THEN left(text, 300) END AS error FROM conversations")
def failed_items(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.length("text") % 3 == 0, F.col("text")).alias("e"))
    return lifecycle.failed(c, F.col("e")).select("conv_id", "turn", "failed", "error")


@says("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 10")
def slice_items(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.sliced(_table(spark, sf, "documents").select("doc_id"), "doc_id", 10, 25)


@says("SELECT 'admin_' || lang || '_' || doc_id AS pair_id FROM documents WHERE NOT (lang IN ('de', 'fr', 'it') AND doc_id IN (18, 100, 106, 153, 196))")
def generated_drop_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = _table(spark, sf, "documents").select(F.concat(F.lit("admin_"), "lang", F.lit("_"), "doc_id").alias("pair_id"))
    return ids.join(F.broadcast(report.drop_ids(spark)), "pair_id", "left_anti")  # five ids a language


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    mode = F.when(F.col("doc_id") % 2 == 0, "align").otherwise("baseline")
    return d.select(F.col("source").alias("run_id"), mode.alias("mode"), F.col("doc_id").alias("seq"), F.col("lang").alias("note"), "n_chars")


_ENTRIES = "e AS (SELECT source AS run_id, CASE WHEN doc_id % 2 = 0 THEN 'align' ELSE 'baseline' END AS mode, doc_id AS seq, lang, lang AS note, n_chars FROM documents)"


@says(f"WITH {_ENTRIES} SELECT run_id, mode, max(seq) AS seq, any_value(first_note) AS note, max_by(n_chars, seq) AS n_chars FROM (SELECT *, first_value(note) OVER (PARTITION BY run_id ORDER BY seq) AS first_note FROM e) GROUP BY run_id, mode")
def manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.upsert(_entries(spark, sf), "seq")


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    mode = F.when(F.col("doc_id") % 2 == 0, "align").otherwise("baseline")
    intended = d.select(F.col("source").alias("run_id"), mode.alias("mode"), "lang", F.col("doc_id").alias("id"))
    failures = _table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("failed"))
    outcomes = intended.drop("lang").join(failures, "id")
    return lifecycle.summaries(intended, outcomes)


_SUMMARIES = _ENTRIES + """, s AS (SELECT run_id, mode, e.lang, count(*) AS n_intended, count(*) FILTER (quality <> 0) AS n_completed, count(*) FILTER (quality = 0) AS n_failed
  FROM e LEFT JOIN labels l ON l.doc_id = e.seq GROUP BY run_id, mode, e.lang),
t AS (SELECT *, n_intended - n_completed AS n_remaining, CASE WHEN n_intended = n_completed THEN 'complete' WHEN n_completed > 0 THEN 'partial' WHEN n_failed > 0 THEN 'started_no_output' ELSE 'not_started' END AS status FROM s)"""


@says(f"WITH {_SUMMARIES} SELECT * FROM t")
def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _summaries(spark, sf)


@says(f"""WITH {_SUMMARIES}, z AS (SELECT lang, count(*) AS n_split FROM documents GROUP BY lang),
m AS (SELECT run_id, mode, sum(n_completed) AS done, sum(n_intended) AS planned, sum(n_split) AS n_split FROM t JOIN z USING (lang) GROUP BY ALL),
r AS (SELECT run_id, list_sort(list(mode) FILTER (done > 0)) AS made, bool_or(done < planned) AS short, round(sum(done) / sum(n_split)::DOUBLE, 4) AS coverage FROM m GROUP BY run_id)
SELECT run_id, coalesce(array_to_string(made, ','), '') AS produced, array_to_string(list_filter(['align', 'baseline'], lambda x: NOT list_contains(coalesce(made, []), x)), ',') AS not_produced, coverage,
  run_id = 'src1' OR coalesce(len(made), 0) < 2 OR short AS partial FROM r""")
def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    split = _table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    capped = spark.createDataFrame([("src1", True)], "run_id string, capped boolean")
    return lifecycle.roll_up(_summaries(spark, sf), split, capped)


@says("""SELECT doc_id, CASE WHEN v AND lang <> 'de' THEN 'judged with a prompt that names another language' END AS defect, CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 3 END::INT AS n_limitations
FROM (SELECT doc_id, lang, doc_id % 3 <> 1 AS v FROM documents)""")
def run_notes(spark: SparkSession, sf: str) -> DataFrame:
    version = F.when(F.col("doc_id") % 3 == 0, "prompts-v1").when(F.col("doc_id") % 3 == 1, "prompts-v2-lang")
    backend = F.when(F.col("doc_id") % 2 == 0, "mock").otherwise("hosted")
    return _table(spark, sf, "documents").select("doc_id", lifecycle.known_defect(version, F.col("lang")).alias("defect"), F.size(lifecycle.limitations(backend)).alias("n_limitations"))


@says("SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS calls FROM events GROUP BY ALL")
def call_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: the tumbling counts of `scoring.call_rates`, over a whole table."""
    r = scoring.call_rates(_table(spark, sf, "events").select("ts", F.col("event_type").alias("kind")), "1 hour")
    return r.select(F.col("window.start").alias("hour"), "kind", "calls")


_SECOND = """, second AS (SELECT s.pair_id, s.lang, s.side, s.k, CASE WHEN length(t.tok) > 4 THEN 1::DOUBLE ELSE 0::DOUBLE END AS pred, s.gold FROM scored s JOIN tokens t ON t.pair_id = s.pair_id AND t.side = s.side AND t.idx = s.k WHERE s.pair_id % 2 = 0)"""


def _by_length(spark: SparkSession, sf: str) -> DataFrame:
    """A second system: tokens of over four characters are different."""
    labels = lambda text: F.transform(T.split_words(F.coalesce(text, F.lit(""))), lambda tok: F.when(F.length(tok) > 4, 1.0).otherwise(0.0))
    return pairs.pair_docs(spark, sf).select("pair_id", "lang", *[labels(f"text_{s}").alias(f"labels_{s}") for s in "ab"])


_EV = oracle._evaluated()


@says(oracle._with(
    _EV + _SECOND + ", both_scored AS (SELECT 'first' AS method, pair_id, lang, side, k, pred, gold FROM scored WHERE pair_id % 2 = 0 UNION ALL SELECT 'second', pair_id, lang, side, k, pred, gold FROM second),"
    + oracle._table("cells", "both_scored", "method", "lang") + "," + oracle._spearman("cells", "method", "lang"),
    "SELECT method, lang, (SELECT count(DISTINCT pair_id) FROM both_scored b WHERE b.method = rho.method AND b.lang = rho.lang) AS n_matched, round(spearman, 6) AS spearman FROM rho",
))
def matched_eval(spark: SparkSession, sf: str) -> DataFrame:
    second = _by_length(spark, sf).filter("pair_id % 2 = 0")
    return report.matched(_predictions(spark, sf), second, _gold(spark, sf)).select("method", "lang", "n_matched", _r("spearman"))


_TAU = """, tau AS (SELECT variant, lang, CASE WHEN p > 0 AND g > 0 THEN c / sqrt(p) / sqrt(g) END AS kendall FROM (
  SELECT a.variant, a.lang, sum(a.w * b.w * sign(a.pred - b.pred) * sign(a.gold - b.gold)) AS c, sum(a.w * b.w * abs(sign(a.pred - b.pred))) AS p, sum(a.w * b.w * abs(sign(a.gold - b.gold))) AS g
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.variant = b.variant GROUP BY a.variant, a.lang))"""


@says(oracle._with(
    _EV + """, toxic AS (SELECT DISTINCT doc_id AS pair_id FROM labels WHERE toxic = 1), v AS (SELECT unnest(['all', 'excluding']) AS variant), l AS (SELECT unnest(['de', 'es', 'fr', 'it']) AS lang),
  items AS (SELECT variant, lang, pair_id, pair_id IN (SELECT pair_id FROM predicted) AS has FROM pair_docs, v WHERE variant = 'all' OR pair_id NOT IN (SELECT pair_id FROM toxic)),
  tagged AS (SELECT variant, s.* FROM scored s JOIN items USING (pair_id, lang)),""" + oracle._table("cells", "tagged", "variant", "lang") + "," + oracle._spearman("cells", "variant", "lang") + _TAU + """,
  n_items AS (SELECT variant, lang, count(*) AS n_gold_items, count(*) FILTER (has) AS n_samples FROM items GROUP BY ALL),
  bad AS (SELECT variant, lang, count(*) FILTER (side = 'a' AND cut <> n) AS bad_a, count(*) FILTER (side = 'b' AND cut <> n AND NOT none) AS bad_b FROM items JOIN predicted USING (pair_id) JOIN cuts USING (pair_id) JOIN gold_size USING (pair_id, side) GROUP BY ALL),
  toks AS (SELECT variant, lang, count(*) AS n_tokens FROM tagged GROUP BY ALL), miss AS (SELECT lang, count(*) FILTER (NOT has) AS missing FROM items WHERE variant = 'all' GROUP BY lang)""",
    """SELECT variant, lang, coalesce(n_gold_items, 0) AS n_gold_items, coalesce(n_samples, 0) AS n_samples, coalesce(n_tokens, 0) AS n_tokens, coalesce(bad_a, 0) AS len_mismatch_a, coalesce(bad_b, 0) AS len_mismatch_b,
  round(coalesce(n_samples / n_gold_items::DOUBLE, 0), 6) AS coverage, coalesce(missing, 0) AS missing, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall,
  CASE WHEN spearman IS NOT NULL THEN NULL WHEN coalesce(n_samples, 0) = 0 THEN 'no predictions' WHEN coalesce(n, 0) < 2 THEN 'fewer than two scored tokens' ELSE 'constant labels' END AS invalid_reason
  FROM v CROSS JOIN l LEFT JOIN n_items USING (variant, lang) LEFT JOIN bad USING (variant, lang) LEFT JOIN toks USING (variant, lang) LEFT JOIN miss USING (lang) LEFT JOIN rho USING (variant, lang) LEFT JOIN tau USING (variant, lang)""",
))
def evaluate_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evaluation as one call; one language has nothing."""
    toxic = _table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("pair_id")).distinct()
    gold = baseline.gold_of(_read(spark, sf))  # the labels of pairs without predictions are compared with nothing
    r = report.evaluate(_predictions(spark, sf), gold, ["de", "es", "fr", "it"], toxic, items=pairs.pair_docs(spark, sf))
    return r.withColumns({"spearman": F.round("spearman", 6), "kendall": F.round("kendall", 6)})


@says(oracle._with(oracle.DOCS, """SELECT lang, coalesce(n, 0) AS n_missing, coalesce(array_to_string(ids[1:5], ','), '') AS first_missing, coalesce(have, 0) = 0 AS absent FROM (SELECT unnest(['de', 'es', 'fr', 'it']) AS lang)
  LEFT JOIN (SELECT lang, count(*) FILTER (NOT has) AS n, list(pair_id ORDER BY pair_id) FILTER (NOT has) AS ids, count(*) FILTER (has) AS have FROM (SELECT lang, pair_id, pair_id IN (SELECT doc_id FROM labels) AS has FROM pair_docs) GROUP BY lang) USING (lang)
  WHERE coalesce(n, 0) > 0 OR coalesce(have, 0) = 0"""))
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    have = _table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"))
    return report.gaps(pairs.pair_docs(spark, sf).select("pair_id", "lang"), have, ["de", "es", "fr", "it"])


@says(oracle._with(
    oracle._baseline() + "," + oracle._gold() + """, all_scored AS (SELECT 'baseline' AS variant, g.lang, b.label AS pred, g.label AS gold FROM gold g JOIN baseline b USING (pair_id, side, idx)
  UNION ALL SELECT 'length', g.lang, CASE WHEN length(t.tok) > 4 THEN 1::DOUBLE ELSE 0::DOUBLE END, g.label FROM gold g JOIN tokens t USING (pair_id, side, idx)),""" + oracle._table("cells", "all_scored", "variant", "lang") + "," + oracle._spearman("cells", "variant", "lang") + _TAU,
    "SELECT variant AS system, lang, round(spearman, 4) AS spearman, round(kendall, 4) AS kendall, round(avg(round(spearman, 4)) OVER (PARTITION BY variant), 4) AS macro FROM rho JOIN tau USING (variant, lang)",
))
def system_comparison(spark: SparkSession, sf: str) -> DataFrame:
    first = baseline.records_of(pairs.pair_docs(spark, sf)).withColumn("system", F.lit("baseline"))
    return report.compare_systems(first.unionByName(_by_length(spark, sf).withColumn("system", F.lit("length"))), _gold(spark, sf))


@query
def token_label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Over document pairs: every token has one label in its domain, whatever the alignment (without SQL; a test holds it against brute force)."""
    p = Pipeline(spark, sf, "docs")
    ok = (F.col("label") == -1) | F.col("label").between(0, 1)
    labels = score.token_labels(p.segments, p.ops, p.judged, p.sides)
    return labels.groupBy("lang", "side").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(ok).alias("n_in_domain"))


@says(oracle._with(oracle._labels() + """,
told AS (SELECT pair_id AS id, n AS sa, m AS sb, 0 AS ops, 0 AS plain, 0 AS hit, 0 AS miss, 0 AS la, 0 AS lb, 0::DOUBLE AS t FROM sizes
  UNION ALL SELECT pair_id, 0, 0, 1, (op = '1:1')::INT, 0, 0, 0, 0, 0 FROM ops UNION ALL SELECT pair_id, 0, 0, 0, 0, (pos IS NOT NULL)::INT, (pos IS NULL)::INT, 0, 0, 0 FROM places
  UNION ALL SELECT pair_id, 0, 0, 0, 0, 0, 0, (side = 'a')::INT, (side = 'b')::INT, label FROM token_labels)""", "SELECT id, sum(sa)::BIGINT AS n_segments_a, sum(sb)::BIGINT AS n_segments_b, sum(ops)::BIGINT AS n_ops, sum(plain)::BIGINT AS n_plain, sum(hit)::BIGINT AS span_matched, sum(miss)::BIGINT AS span_unmatched, sum(la)::BIGINT AS n_labels_a, sum(lb)::BIGINT AS n_labels_b, round(sum(t), 4) AS total, false AS failed FROM told GROUP BY id"))
def run_details(spark: SparkSession, sf: str) -> DataFrame:
    """A run over conversation pairs, its records written and read again."""
    items = pairs.pair_conv(spark, sf).select(F.col("pair_id").alias("id"), "lang", "text_a", "text_b")
    run = runner.predict(spark, shared_folder(spark, "runs"), items, runner.Plan("align", "dev/val", ("xx",)))
    total = F.round(F.reduce(F.concat("labels_a", "labels_b"), F.lit(0.0), lambda s, x: s + x), 4)
    stats = F.col("stats")
    return run.details.select(
        "id", F.size("segments_a").cast("long").alias("n_segments_a"), F.size("segments_b").cast("long").alias("n_segments_b"), F.size("ops").cast("long").alias("n_ops"),
        F.coalesce(F.try_element_at(stats["ops"], F.lit("1:1")), F.lit(0)).alias("n_plain"), stats["span_matched"].alias("span_matched"), stats["span_unmatched"].alias("span_unmatched"),
        F.size("labels_a").cast("long").alias("n_labels_a"), F.size("labels_b").cast("long").alias("n_labels_b"), total.alias("total"), "failed",
    )


@says(f"WITH {oracle.DOCS} SELECT lang, pair_id FROM pair_docs WHERE pair_id IN (SELECT doc_id FROM labels) AND pair_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def matched_list(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of both methods, in order."""
    known = _table(spark, sf, "labels").select(F.col("doc_id").alias("pair_id"), "quality")
    return report.matched_list(known, known.filter("quality = 1"), pairs.pair_docs(spark, sf))
