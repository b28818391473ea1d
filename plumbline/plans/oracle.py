"""The same results in SQL over the same tables, as independent statements."""

from __future__ import annotations

from ..functions import text as T
from ..operators import guard


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


DOCS = """pair_docs AS (
  SELECT a.doc_id AS pair_id, b.lang, a.text AS text_a, b.text AS text_b
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents WHERE lang = 'en') a
  JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents WHERE lang <> 'en') b
  ON a.source = b.source AND a.r = b.r)"""
CONV = """pair_conv AS (
  SELECT a.conv_id || '-' || a.turn AS pair_id, 'xx' AS lang, a.text AS text_a, b.text AS text_b
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""
VIEWS = {"docs": DOCS, "conv": CONV}

LOW_ENUM = _q(T.ENUMERATION)


def _tokens(view: str) -> str:
    return f"""{VIEWS[view]},
sides AS (SELECT pair_id, lang, 'a' AS side, text_a AS text FROM pair_{view} UNION ALL SELECT pair_id, lang, 'b', text_b FROM pair_{view}),
pieces AS (SELECT pair_id, lang, side, unnest(l) AS piece, unnest(range(len(l))) AS idx
  FROM (SELECT pair_id, lang, side, regexp_extract_all(text, {_q(T.PIECE)}) AS l FROM sides)),
toks0 AS (SELECT *, regexp_replace(piece, {_q(T.LEAD)}, '') AS tok FROM pieces),
toks1 AS (SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, side ORDER BY idx) AS e, count(*) OVER (PARTITION BY pair_id, side) AS n_tok,
  lead(piece[:length(piece) - length(tok)]) OVER (PARTITION BY pair_id, side ORDER BY idx) AS gap FROM toks0),
toks2 AS (SELECT *, idx + 1 < n_tok AND (contains(gap, chr(10)) OR (regexp_matches(regexp_replace(tok, {_q(T.CLOSERS)}, ''), {_q(T.TERMINAL)})
  AND NOT list_contains({_list(T.ABBREVIATIONS)}, lower(tok)) AND NOT regexp_matches(lower(tok), {LOW_ENUM}))) AS ends FROM toks1),
tokens AS (SELECT pair_id, lang, side, idx, piece, tok, (e - length(tok)) AS s, e, n_tok,
  coalesce(sum(ends::INT) OVER (PARTITION BY pair_id, side ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM toks2)"""


def _segments(view: str) -> str:
    return _tokens(view) + f""",
segments AS (SELECT pair_id, side, seg, any_value(lang) AS lang, min(idx) AS tok_lo, max(idx) + 1 AS tok_hi, min(s) AS char_lo,
  regexp_replace(string_agg(piece, '' ORDER BY idx), {_q(T.LEAD)}, '') AS text FROM tokens GROUP BY pair_id, side, seg),
sizes AS (SELECT pair_id, any_value(lang) AS lang, count(*) FILTER (side = 'a') AS n, count(*) FILTER (side = 'b') AS m FROM segments GROUP BY pair_id)"""


def _norm(text: str) -> str:
    strip = _q(T.NORM_STRIP)
    return f"list_filter(list_transform(regexp_extract_all({text}, {_q(T.WORD)}), lambda t: trim(lower(t), {strip})), lambda t: t <> '')"


BOOK = "MAP {" + ", ".join(f"{_q(k)}: {_list(v)}" for k, v in T.COGNATES.items()) + "}"


def _lexical(a: str, b: str) -> str:
    number = _q(T.NUMBER)
    na, nb = (f"list_filter({x}, lambda t: regexp_matches(t, {number}))" for x in (a, b))
    both = f"len(list_intersect({na}, {nb}))"
    foreign = f"len(list_filter({a}, lambda t: NOT list_contains({b}, t) AND NOT regexp_matches(t, {number}) AND list_has_any(coalesce(({BOOK})[t], []), {b})))"
    overlap = f"(len(list_intersect({a}, {b})) + 0.9::DOUBLE * {foreign} + ({both} + 0.5::DOUBLE * least(len({na}), len({nb})) - 0.5::DOUBLE * {both}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 2 * {overlap} / (len({a}) + len({b})))) END"


def _hash8(joined: str) -> str:
    return f"('0x' || sha256({joined})[:8])::BIGINT"


def _noise(a: str, b: str) -> str:
    return f"(({_hash8(f'{a} || chr(124) || {b} || chr(124) || chr(48)')})::DOUBLE / 4294967295::DOUBLE - 0.5::DOUBLE) * 0.3::DOUBLE"


BAND = "(abs(i / greatest(n - 1, 1)::DOUBLE - j / greatest(m - 1, 1)::DOUBLE) <= 0.2::DOUBLE OR abs(i * m / n::DOUBLE - j) <= 2)"


def _candidates(view: str) -> str:
    return _segments(view) + f""",
full_grid AS (SELECT pair_id, lang, n, m, i, unnest(range(m)) AS j FROM (SELECT *, unnest(range(n)) AS i FROM sizes WHERE n > 0 AND m > 0)),
candidates AS (SELECT * FROM full_grid WHERE {BAND})"""


def _scored(view: str) -> str:
    return _candidates(view) + f""",
sets AS (SELECT *, list_distinct({_norm('text')}) AS words FROM segments),
scored0 AS (SELECT c.*, {_lexical('a.words', 'b.words')} AS lexical, a.text AS ta, b.text AS tb
  FROM candidates c JOIN sets a ON a.pair_id = c.pair_id AND a.side = 'a' AND a.seg = c.i JOIN sets b ON b.pair_id = c.pair_id AND b.side = 'b' AND b.seg = c.j),
scored1 AS (SELECT *, round_even(5 * greatest(0::DOUBLE, least(1::DOUBLE, lexical + {_noise('ta', 'tb')})), 1) AS score FROM scored0),
scored AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, score / 5)) AS sim FROM scored1)"""


_S = "coalesce(sims[{i} * m + {j} + 1], 0::DOUBLE)"


def _aligned() -> str:
    """Alignment cell by cell in row order, then back from the last cell."""
    s = lambda i, j: _S.format(i=i, j=j)
    at = lambda i, j: f"st[({i}) * (m + 1) + ({j}) + 1].c"
    s1, s2, s3 = s("(i - 1)", "(j - 1)"), f"(({s('(i - 1)', '(j - 2)')} + {s('(i - 1)', '(j - 1)')}) / 2::DOUBLE)", f"(({s('(i - 2)', '(j - 1)')} + {s('(i - 1)', '(j - 1)')}) / 2::DOUBLE)"
    inf = "'infinity'::DOUBLE"
    return _scored("conv") + f""",
matrix AS (SELECT z.pair_id, z.lang, z.n, z.m, list(coalesce(sc.sim, 0::DOUBLE) ORDER BY g.i, g.j) AS sims
  FROM sizes z JOIN full_grid g USING (pair_id) LEFT JOIN scored sc ON sc.pair_id = g.pair_id AND sc.i = g.i AND sc.j = g.j WHERE z.n > 0 AND z.m > 0
  GROUP BY z.pair_id, z.lang, z.n, z.m),
walk AS (
  SELECT pair_id, n, m, sims, 1::BIGINT AS k, [{{'c': 0::DOUBLE, 'o': 0, 's': 0::DOUBLE}}] AS st FROM matrix
  UNION ALL
  SELECT pair_id, n, m, sims, k + 1, list_append(st, CASE
     WHEN c1 <= c2 AND c1 <= c3 AND c1 <= c4 AND c1 <= c5 THEN {{'c': c1, 'o': 1, 's': s1}}
     WHEN c2 <= c3 AND c2 <= c4 AND c2 <= c5 THEN {{'c': c2, 'o': 2, 's': s2}}
     WHEN c3 <= c4 AND c3 <= c5 THEN {{'c': c3, 'o': 3, 's': s3}}
     WHEN c4 <= c5 THEN {{'c': c4, 'o': 4, 's': 0::DOUBLE}} ELSE {{'c': c5, 'o': 5, 's': 0::DOUBLE}} END)
  FROM (SELECT *,
      CASE WHEN i >= 1 AND j >= 1 THEN {at('i - 1', 'j - 1')} + ((1::DOUBLE - s1) + CASE WHEN s1 < 0.15::DOUBLE THEN 0.35::DOUBLE ELSE 0::DOUBLE END) ELSE {inf} END AS c1,
      CASE WHEN i >= 1 AND j >= 2 THEN {at('i - 1', 'j - 2')} + ((1::DOUBLE - s2) + 0.2::DOUBLE) ELSE {inf} END AS c2,
      CASE WHEN i >= 2 AND j >= 1 THEN {at('i - 2', 'j - 1')} + ((1::DOUBLE - s3) + 0.2::DOUBLE) ELSE {inf} END AS c3,
      CASE WHEN i >= 1 THEN {at('i - 1', 'j')} + 0.55::DOUBLE ELSE {inf} END AS c4,
      CASE WHEN j >= 1 THEN {at('i', 'j - 1')} + 0.55::DOUBLE ELSE {inf} END AS c5
    FROM (SELECT *, CASE WHEN i >= 1 AND j >= 1 THEN {s1} ELSE 0::DOUBLE END AS s1, CASE WHEN i >= 1 AND j >= 2 THEN {s2} ELSE 0::DOUBLE END AS s2,
            CASE WHEN i >= 2 AND j >= 1 THEN {s3} ELSE 0::DOUBLE END AS s3
          FROM (SELECT *, k // (m + 1) AS i, k % (m + 1) AS j FROM walk WHERE k < (n + 1) * (m + 1))))),
ends AS (SELECT pair_id, n, m, st FROM walk WHERE k = (n + 1) * (m + 1)),
back AS (
  SELECT pair_id, m, st, n AS i, m AS j, 0 AS step, 0 AS o, 0::DOUBLE AS s FROM ends
  UNION ALL
  SELECT pair_id, m, st, i - CASE o2 WHEN 3 THEN 2 WHEN 5 THEN 0 ELSE 1 END, j - CASE o2 WHEN 2 THEN 2 WHEN 4 THEN 0 ELSE 1 END, step + 1, o2, s2
  FROM (SELECT *, st[i * (m + 1) + j + 1].o AS o2, st[i * (m + 1) + j + 1].s AS s2 FROM back WHERE i > 0 OR j > 0)),
ops0 AS (SELECT pair_id, i, j, o, s, row_number() OVER (PARTITION BY pair_id ORDER BY step DESC) - 1 AS op_idx FROM back WHERE step > 0),
ops AS (SELECT o0.pair_id, z.lang, z.n, z.m, op_idx, ['1:1', '1:2', '2:1', '1:0', '0:1'][o] AS op,
    CASE o WHEN 5 THEN -1 ELSE i END AS a_start, CASE o WHEN 5 THEN -1 WHEN 3 THEN i + 2 ELSE i + 1 END AS a_end,
    CASE o WHEN 4 THEN -1 ELSE j END AS b_start, CASE o WHEN 4 THEN -1 WHEN 2 THEN j + 2 ELSE j + 1 END AS b_end, s AS sim
  FROM ops0 o0 JOIN sizes z USING (pair_id))"""


def _judged(spans_of: str = "", difference: str = "j0.difference") -> str:
    own = lambda x, y: f"list_filter(regexp_extract_all({x}, {_q(T.WORD)}), lambda t: NOT list_contains(list_transform(regexp_extract_all({y}, {_q(T.WORD)}), lambda u: lower(u)), lower(t)))"
    span = lambda x, y: f"CASE WHEN difference >= 2 AND len({own(x, y)}) > 0 THEN array_to_string(({own(x, y)})[:3], ' ') END"
    side = lambda s: f"""(SELECT o.pair_id, o.op_idx, string_agg(g.text, ' ' ORDER BY g.seg) AS text, min(g.tok_lo) AS tok_lo, max(g.tok_hi) AS tok_hi, min(g.char_lo) AS char_lo
      FROM ops o JOIN segments g ON g.pair_id = o.pair_id AND g.side = '{s}' AND g.seg >= o.{s}_start AND g.seg < o.{s}_end WHERE o.{s}_start >= 0 GROUP BY o.pair_id, o.op_idx)"""  # noqa: E731
    return _aligned() + f""",
texts AS (SELECT o.*, a.text AS text_a, b.text AS text_b, a.tok_lo AS tok_lo_a, a.tok_hi AS tok_hi_a, a.char_lo AS char_lo_a, b.tok_lo AS tok_lo_b, b.tok_hi AS tok_hi_b,
    b.char_lo AS char_lo_b, list_distinct({_norm('a.text')}) AS wa, list_distinct({_norm('b.text')}) AS wb
  FROM ops o JOIN {side('a')} a ON a.pair_id = o.pair_id AND a.op_idx = o.op_idx JOIN {side('b')} b ON b.pair_id = o.pair_id AND b.op_idx = o.op_idx),
judged0 AS (SELECT *, greatest(0, least(5, round_even(5 * (1::DOUBLE - ({_lexical('wa', 'wb')})) + {_noise('text_a', 'text_b')} * 3, 0)))::INT AS difference FROM texts),
judged1 AS (SELECT *, {span('text_a', 'text_b')} AS sa, {span('text_b', 'text_a')} AS sb FROM judged0),
judged AS (SELECT j0.* EXCLUDE (difference), {difference} AS difference, CASE WHEN contains(text_a, sa) THEN sa END AS span_a, CASE WHEN contains(text_b, sb) THEN sb END AS span_b FROM judged1 j0),
spans AS ({spans_of or f"""SELECT pair_id, op_idx, 'a' AS side, span_a AS span, tok_lo_a AS tok_lo, tok_hi_a AS tok_hi, char_lo_a AS char_lo FROM judged WHERE span_a IS NOT NULL
  UNION ALL SELECT pair_id, op_idx, 'b', span_b, tok_lo_b, tok_hi_b, char_lo_b FROM judged WHERE span_b IS NOT NULL"""}),
places AS (SELECT sp.pair_id, sp.op_idx, sp.side, sp.span, sp.tok_lo, sp.tok_hi,
    CASE WHEN instr(t.text[sp.char_lo + 1:], sp.span) > 0 THEN instr(t.text[sp.char_lo + 1:], sp.span) - 1 + sp.char_lo WHEN instr(t.text, sp.span) > 0 THEN instr(t.text, sp.span) - 1 END AS pos
  FROM spans sp JOIN sides t ON t.pair_id = sp.pair_id AND t.side = sp.side),
span_toks AS (SELECT p.*, t.idx FROM places p JOIN tokens t ON t.pair_id = p.pair_id AND t.side = p.side AND t.s < p.pos + length(p.span) AND t.e > p.pos WHERE p.pos IS NOT NULL)"""


def _replied() -> str:
    """Judgments as replies tell them: up to three differing words, each a span of its own; every fifth operation without an understood reply."""
    own = lambda x, y: f"(list_filter(regexp_extract_all({x}, {_q(T.WORD)}), lambda t: NOT list_contains(list_transform(regexp_extract_all({y}, {_q(T.WORD)}), lambda u: lower(u)), lower(t))))[:3]"
    one = lambda s, o: f"SELECT pair_id, op_idx, '{s}' AS side, span, tok_lo, tok_hi, char_lo FROM (SELECT pair_id, op_idx, tok_lo_{s} AS tok_lo, tok_hi_{s} AS tok_hi, char_lo_{s} AS char_lo, {own(f'text_{s}', f'text_{o}')} AS l FROM judged WHERE difference IS NOT NULL) q, unnest(q.l) t(span)"
    return _judged(one("a", "b") + " UNION ALL " + one("b", "a"), "CASE WHEN op_idx % 5 <> 3 THEN j0.difference END")


def _labels(boost: str = "0.25::DOUBLE", omit: str = "0.9::DOUBLE", add: str = "0.9::DOUBLE", extra: str = "", cross: str = "", judged: str = "") -> str:
    level = "coalesce(l.difference / 5::DOUBLE, least(1::DOUBLE, 1::DOUBLE - l.sim))"
    return (judged or _judged()) + f""",
levels AS (SELECT o.pair_id, o.op_idx, 'a' AS side, unnest(range(o.a_start, o.a_end)) AS seg, o.op, j.difference, o.sim FROM ops o LEFT JOIN judged j ON j.pair_id = o.pair_id AND j.op_idx = o.op_idx WHERE o.a_start >= 0
  UNION ALL SELECT o.pair_id, o.op_idx, 'b', unnest(range(o.b_start, o.b_end)), o.op, j.difference, o.sim FROM ops o LEFT JOIN judged j ON j.pair_id = o.pair_id AND j.op_idx = o.op_idx WHERE o.b_start >= 0),
boosted AS (SELECT DISTINCT pair_id, op_idx, side, idx FROM span_toks WHERE idx >= tok_lo AND idx < tok_hi),
token_labels AS (SELECT {extra} t.pair_id, t.lang, t.side, t.idx, t.tok, CASE WHEN regexp_matches(t.tok, {_q(T.PUNCTUATION)}) THEN -1::DOUBLE WHEN l.op = '1:0' THEN {omit} WHEN l.op = '0:1' THEN {add}
    WHEN l.op IS NULL THEN 0::DOUBLE WHEN b.idx IS NOT NULL THEN least(1::DOUBLE, greatest(0.6::DOUBLE, least(1::DOUBLE, {level} + {boost}))) ELSE {level} END AS label
  FROM tokens t {cross} LEFT JOIN levels l ON l.pair_id = t.pair_id AND l.side = t.side AND l.seg = t.seg
  LEFT JOIN boosted b ON b.pair_id = t.pair_id AND b.op_idx = l.op_idx AND b.side = t.side AND b.idx = t.idx)"""


def _gold() -> str:
    h = _hash8("pair_id::VARCHAR || '|' || side || '|' || idx::VARCHAR")
    return f"gold AS (SELECT pair_id, lang, side, idx, CASE WHEN regexp_matches(tok, {_q(T.PUNCTUATION)}) THEN -1::DOUBLE ELSE ({h} % 6) / 5::DOUBLE END AS label FROM tokens)"


def _baseline(view: str = "docs") -> str:
    strip = _q(T.MATCH_STRIP)
    guess = f"(trunc(2 + ({_noise('t.tok', 't.side')}) * 6)::INT % 4)"
    return _tokens(view) + f""",
others AS (SELECT DISTINCT pair_id, CASE side WHEN 'a' THEN 'b' ELSE 'a' END AS side, trim(lower(tok), {strip}) AS norm FROM tokens),
coded AS (SELECT t.pair_id, t.lang, t.side, t.idx, t.tok, CASE WHEN regexp_matches(t.tok, {_q(T.ALL_PUNCTUATION)}) THEN -1 WHEN o.norm IS NOT NULL OR regexp_matches(t.tok, '^\\p{{Nd}}+$') THEN 5 ELSE {guess} END AS code
  FROM tokens t LEFT JOIN others o ON o.pair_id = t.pair_id AND o.side = t.side AND o.norm = trim(lower(t.tok), {strip})),
baseline AS (SELECT *, CASE WHEN code >= 0 THEN 1::DOUBLE - code / 5::DOUBLE ELSE -1::DOUBLE END AS label FROM coded)"""


def _evaluated() -> str:
    """Predictions exist for the pairs whose English document is in ``labels``; their text was cut at single spaces."""
    return _baseline() + "," + _gold() + """,
predicted AS (SELECT DISTINCT p.pair_id FROM pair_docs p JOIN labels l ON l.doc_id = p.pair_id),
cuts AS (SELECT pair_id, 'a' AS side, len(string_split(text_a, ' ')) AS cut FROM pair_docs UNION ALL SELECT pair_id, 'b', len(string_split(text_b, ' ')) FROM pair_docs),
gold_size AS (SELECT pair_id, side, count(*) AS n, bool_and(label = -1) AS none FROM gold GROUP BY pair_id, side),
scored AS (SELECT g.pair_id, g.lang, g.side, g.idx AS k, CASE WHEN g.idx < c.cut THEN b.label ELSE 0::DOUBLE END AS pred, g.label AS gold
  FROM gold g JOIN predicted USING (pair_id) JOIN baseline b ON b.pair_id = g.pair_id AND b.side = g.side AND b.idx = g.idx
  JOIN cuts c ON c.pair_id = g.pair_id AND c.side = g.side JOIN gold_size z ON z.pair_id = g.pair_id AND z.side = g.side WHERE g.side = 'a' OR NOT z.none)"""


def _spearman(source: str, *keys: str, name: str = "rho") -> str:
    """CTE ``name``(keys, n, spearman) from contingency ``source``(keys, pred, gold, w)."""
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    rank = lambda c: f"SELECT {k}{c}, coalesce(sum(n) OVER ({part} ORDER BY {c} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2::DOUBLE AS r FROM (SELECT {k}{c}, sum(w) AS n FROM {source} GROUP BY ALL)"
    on = lambda a, c: " AND ".join([f"t.{x} = {a}.{x}" for x in keys] + [f"t.{c} = {a}.{c}"])
    tk = "".join(f"t.{x}, " for x in keys)
    return f"""{name}_sums AS (SELECT {tk} sum(w) AS n, sum(w * x.r) AS sx, sum(w * y.r) AS sy, sum(w * x.r * y.r) AS sxy, sum(w * x.r * x.r) AS sxx, sum(w * y.r * y.r) AS syy
  FROM {source} t JOIN ({rank('pred')}) x ON {on('x', 'pred')} JOIN ({rank('gold')}) y ON {on('y', 'gold')} {'GROUP BY ' + ', '.join(f't.{x}' for x in keys) if keys else ''}),
{name} AS (SELECT {k} n, CASE WHEN n >= 2 AND n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0 THEN (n * sxy - sx * sy) / sqrt(n * sxx - sx * sx) / sqrt(n * syy - sy * sy) END AS spearman FROM {name}_sums)"""


def _unit(key: str) -> str:
    return f"({_hash8(key)})::DOUBLE / 4294967296::DOUBLE"


def _table(name: str, source: str, *keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    return f"{name} AS (SELECT {k} pred, gold, count(*)::DOUBLE AS w FROM {source} WHERE gold <> -1 GROUP BY ALL)"


def _poisson(u: str) -> str:
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return "(" + " + ".join(f"({u} >= {c}::DOUBLE)::INT" for c in cuts) + ")"


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def statements() -> dict[str, str]:
    ev = _evaluated()
    by_lang = ev + "," + _table("cells", "scored", "lang")
    variants = ev + """,
toxic AS (SELECT DISTINCT doc_id AS pair_id FROM labels WHERE toxic = 1),
tagged AS (SELECT 'all' AS variant, * FROM scored UNION ALL SELECT 'excluding', s.* FROM scored s ANTI JOIN toxic USING (pair_id)),""" + _table("cells", "tagged", "variant", "lang")
    tau = """SELECT lang, round(CASE WHEN p > 0 AND g > 0 THEN c / sqrt(p) / sqrt(g) END, 6) AS kendall FROM (
  SELECT a.lang, sum(a.w * b.w * sign(a.pred - b.pred) * sign(a.gold - b.gold)) AS c, sum(a.w * b.w * abs(sign(a.pred - b.pred))) AS p, sum(a.w * b.w * abs(sign(a.gold - b.gold))) AS g
  FROM cells a JOIN cells b ON a.lang = b.lang GROUP BY a.lang)"""
    u_doc = f"({_hash8(chr(39).join(['rep::VARCHAR || ', '|', ' || pair_id::VARCHAR']))})::DOUBLE / 4294967296::DOUBLE"
    boot = by_lang + f""",
reps AS (SELECT lang, pred, gold, w AS mean, rep, rep::VARCHAR || '|' || lang || '|' || round(pred * 1000000)::BIGINT || '|' || round(gold * 1000000)::BIGINT || '|' AS key FROM cells, range(2000) r(rep)),
hashed AS (SELECT *, {_unit("key || 'u'")} AS u, sqrt(-2 * ln({_unit("key || 'r'")} + 1.1641532182693481e-10)) * cos(6.283185307179586::DOUBLE * {_unit("key || 'a'")}) AS z FROM reps),
terms AS (SELECT lang, pred, gold, list(p ORDER BY k) AS ps FROM (SELECT lang, pred, gold, k, exp(-mean + sum(CASE WHEN k = 0 THEN 0::DOUBLE ELSE ln(mean / k) END) OVER (PARTITION BY lang, pred, gold ORDER BY k)) AS p
  FROM (SELECT lang, pred, gold, w AS mean, unnest(range(ceil(w + 12 * sqrt(w) + 21)::BIGINT)) AS k FROM cells WHERE w <= 30)) GROUP BY ALL),
upto AS (SELECT lang, pred, gold, list(s ORDER BY k) AS sums FROM (SELECT lang, pred, gold, k, sum(p) OVER (PARTITION BY lang, pred, gold ORDER BY k) AS s FROM (SELECT lang, pred, gold, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM terms)) GROUP BY ALL),
drawn AS (SELECT lang, rep, pred, gold, CASE WHEN mean <= 30 THEN len(list_filter(sums, lambda s: s <= u))::DOUBLE ELSE greatest(0::DOUBLE, floor(mean + sqrt(mean) * z + (z * z - 1::DOUBLE) / 6::DOUBLE + 0.5::DOUBLE)) END AS w
  FROM hashed LEFT JOIN upto USING (lang, pred, gold)),
weighed AS (SELECT * FROM drawn WHERE w > 0),""" + _spearman("weighed", "lang", "rep")
    many = ev + f""",
tokens_scored AS (SELECT lang, gold / 4::DOUBLE + ({_hash8("'score|' || pair_id::VARCHAR || '|' || side || '|' || idx::VARCHAR")})::DOUBLE / 4294967296::DOUBLE AS pred, gold FROM (SELECT pair_id, lang, side, idx, label AS gold FROM gold)),""" + _table("cells", "tokens_scored", "lang") + "," + _spearman("cells", "lang") + f""",
by_pred AS (SELECT lang, pred, {", ".join(f"sum(w) FILTER (gold = {k} / 5::DOUBLE) AS g{k}" for k in range(6))} FROM cells GROUP BY lang, pred),
under AS (SELECT lang, pred, {", ".join(f"coalesce(g{k}, 0) AS g{k}, coalesce(sum(coalesce(g{k}, 0)) OVER (PARTITION BY lang ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u{k}" for k in range(6))} FROM by_pred),
inversions AS (SELECT lang, sum({" + ".join(f"g{a} * u{b} * {1 if b < a else -1}" for a in range(6) for b in range(6) if a != b)}) AS s FROM under GROUP BY lang),
ties AS (SELECT lang, (n * n - pp) / 2 AS p, (n * n - gg) / 2 AS g FROM (SELECT lang, sum(w) AS n FROM cells GROUP BY lang)
  JOIN (SELECT lang, sum(t * t) AS pp FROM (SELECT lang, sum(w) AS t FROM cells GROUP BY lang, pred) GROUP BY lang) USING (lang)
  JOIN (SELECT lang, sum(t * t) AS gg FROM (SELECT lang, sum(w) AS t FROM cells GROUP BY lang, gold) GROUP BY lang) USING (lang))"""
    second = ev + """,
constant AS (SELECT pair_id, lang, side, k, CASE WHEN length(t.tok) > 4 THEN 1::DOUBLE ELSE 0::DOUBLE END AS pred, gold FROM scored s JOIN tokens t USING (pair_id, lang, side) WHERE t.idx = s.k)"""
    macro = lambda src, n: f"""{n}_docs AS (SELECT lang, pair_id, pred, gold, count(*)::DOUBLE AS w FROM {src} WHERE gold <> -1 GROUP BY ALL),
{n}_draws AS (SELECT lang, rep, pred, gold, w * {_poisson(u_doc)} AS pw FROM (SELECT *, unnest(range(50)) AS rep FROM {n}_docs)),
{n}_cells AS (SELECT lang, rep, pred, gold, sum(pw) AS w FROM {n}_draws GROUP BY ALL HAVING sum(pw) > 0), {_spearman(n + '_cells', 'lang', 'rep', name=n + '_rho')},
{n} AS (SELECT rep, avg(spearman) AS v FROM {n}_rho GROUP BY rep)"""  # noqa: E731
    paired = second + "," + macro("scored", "one") + "," + macro("constant", "two")
    grid_cte = "grid AS (SELECT (row_number() OVER (ORDER BY b, o, a) - 1)::INT AS grid_idx, b::DOUBLE AS gb, o::DOUBLE AS go, a::DOUBLE AS ga FROM unnest([0.0, 0.2, 0.4]) t1(b), unnest([0.7, 0.9, 1.0]) t2(o), unnest([0.7, 0.9, 1.0]) t3(a))"
    gridded = grid_cte + "," + _labels("gr.gb", "gr.go", "gr.ga", extra="gr.grid_idx,", cross="CROSS JOIN grid gr") + "," + _gold() + """,
pooled AS (SELECT l.grid_idx, l.lang, l.label AS pred, g.label AS gold FROM token_labels l JOIN gold g ON g.pair_id = l.pair_id AND g.side = l.side AND g.idx = l.idx),""" + _table("cells", "pooled", "grid_idx", "lang") + "," + _spearman("cells", "grid_idx", "lang")
    status = "CASE WHEN done >= n_intended THEN 'complete' WHEN done > 0 THEN 'partial' WHEN started THEN 'started_no_output' ELSE 'not_started' END"
    lang_done = f"""{DOCS}, i AS (SELECT lang, count(*) AS n_intended FROM pair_docs GROUP BY lang), c AS (SELECT lang, count(*) AS n FROM pair_docs WHERE pair_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
done AS (SELECT i.lang, n_intended, coalesce(n, 0) AS done, true AS started FROM i LEFT JOIN c USING (lang))"""
    t = {
        "tokens_offsets": _with(_tokens("docs"), "SELECT pair_id, side, idx::INT AS idx, tok, s::INT AS start_char, e::INT AS end_char FROM tokens"),
        "punctuation_mask": _with(_tokens("docs"), f"SELECT lang, side, count(*) AS n_tokens, count(*) FILTER (regexp_matches(tok, {_q(T.PUNCTUATION)})) AS n_punctuation FROM tokens GROUP BY ALL"),
        "symbol_tokens": _with(_tokens("docs"), f"SELECT lang, side, count(*) FILTER (regexp_matches(tok, {_q(T.SYMBOLS)})) AS n_symbols FROM tokens GROUP BY ALL"),
        "op_tokens": _with(_aligned(), "SELECT o.pair_id, op_idx::INT AS op_idx, side, min(tok_lo)::INT AS lo, max(tok_hi)::INT AS hi FROM ops o JOIN segments g ON g.pair_id = o.pair_id AND ((side = 'a' AND seg >= a_start AND seg < a_end) OR (side = 'b' AND seg >= b_start AND seg < b_end)) GROUP BY ALL"),
        "terminal_flags": _with(_tokens("docs"), f"SELECT lang, side, count(*) FILTER (regexp_matches(regexp_replace(tok, {_q(T.CLOSERS)}, ''), {_q(T.TERMINAL)})) AS n_terminal, count(*) FILTER (regexp_matches(lower(tok), {LOW_ENUM})) AS n_enumeration, count(*) FILTER (list_contains({_list(T.ABBREVIATIONS)}, lower(tok))) AS n_abbreviation FROM tokens GROUP BY ALL"),
        "segments": _with(_segments("docs"), "SELECT pair_id, side, seg::INT AS seg, tok_lo::INT AS tok_lo, tok_hi::INT AS tok_hi FROM segments"),
        "segment_texts": _with(_segments("docs"), "SELECT pair_id, side, seg::INT AS seg, char_lo::INT AS char_lo, text FROM segments"),
        "segment_counts": _with(_segments("docs"), "SELECT lang, side, count(DISTINCT pair_id) AS n_texts, count(*) AS n_segments, sum(tok_hi - tok_lo)::BIGINT AS n_tokens FROM segments GROUP BY ALL"),
        "band_candidates": _with(_candidates("docs"), "SELECT pair_id, i::INT AS i, j::INT AS j FROM candidates"),
        "band_reduction": _with(_candidates("docs"), "SELECT lang, sum(n * m)::BIGINT AS full_cells, (SELECT count(*) FROM candidates c WHERE c.lang = z.lang) AS banded_cells FROM sizes z GROUP BY lang"),
        "batch_ids": _with(_candidates("docs"), "SELECT pair_id, batch::INT AS batch, count(*) AS n_cells FROM (SELECT pair_id, (row_number() OVER (PARTITION BY pair_id ORDER BY i, j) - 1) // 20 AS batch FROM candidates) GROUP BY ALL"),
        "norm_tokens": _with(_segments("docs"), f"SELECT word, count(*) AS n FROM (SELECT unnest({_norm('text')}) AS word FROM segments) GROUP BY word"),
        "lexical_similarity": _with(_scored("docs"), "SELECT pair_id, i::INT AS i, j::INT AS j, round(lexical, 6) AS lexical FROM scored"),
        "noise_hash": f"SELECT doc_id, round({_noise('text', 'lang')}, 9) AS noise FROM documents",
        "pair_scores": _with(_scored("docs"), "SELECT pair_id, i::INT AS i, j::INT AS j, round(score, 1) AS score, round(sim, 6) AS sim FROM scored"),
        "align_ops": _with(_aligned(), "SELECT pair_id, op_idx::INT AS op_idx, op, a_start::INT AS a_start, a_end::INT AS a_end, b_start::INT AS b_start, b_end::INT AS b_end, round(sim, 6) AS sim FROM ops"),
        "op_histogram": _with(_aligned(), "SELECT op, count(*) AS n_ops FROM ops GROUP BY op"),
        "align_coverage": _with(_aligned(), "SELECT pair_id, (sum(CASE WHEN a_start >= 0 THEN a_end - a_start ELSE 0 END) = any_value(n)) AS a_complete, (sum(CASE WHEN b_start >= 0 THEN b_end - b_start ELSE 0 END) = any_value(m)) AS b_complete, count(*) AS n_ops FROM ops GROUP BY pair_id"),
        "mock_judgments": _with(_judged(), "SELECT pair_id, op_idx::INT AS op_idx, difference FROM judged"),
        "verbatim_spans": _with(_judged(), "SELECT pair_id, op_idx::INT AS op_idx, span_a, span_b FROM judged WHERE difference >= 2"),
        "span_token_ranges": _with(_judged(), "SELECT pair_id, op_idx::INT AS op_idx, side, pos::INT AS pos, min(idx)::INT AS lo, (max(idx) + 1)::INT AS hi FROM span_toks GROUP BY ALL"),
        "token_labels": _with(_labels(), "SELECT pair_id, side, idx::INT AS idx, tok, round(label, 6) AS label FROM token_labels"),
        "label_stats": _with(_judged(), "SELECT count(*) FILTER (pos IS NOT NULL) AS span_matched, count(*) FILTER (pos IS NULL) AS span_unmatched, 0::BIGINT AS parse_failures, 0::BIGINT AS repairs FROM places"),
        "baseline_labels": _with(_baseline(), "SELECT pair_id, side, idx::INT AS idx, code::INT AS code, round(label, 6) AS label FROM baseline"),
        "sim_to_diff_map": "SELECT quality, round(CASE WHEN quality >= 0 THEN 1::DOUBLE - quality / 5::DOUBLE ELSE -1::DOUBLE END, 6) AS difference, count(*) AS n FROM labels GROUP BY ALL",
        "pred_gold_join": _with(ev, "SELECT lang, side, count(*) AS n_tokens, round(sum(pred), 4) AS sum_pred, round(sum(gold), 4) AS sum_gold FROM scored GROUP BY ALL"),
        "missing_ids": _with(ev, "SELECT pair_id, lang FROM pair_docs ANTI JOIN predicted USING (pair_id)"),
        "pad_truncate": _with(ev, "SELECT lang, count(DISTINCT pair_id) AS n_samples, count(*) FILTER (side = 'a' AND cut <> n) AS len_mismatch_a, count(*) FILTER (side = 'b' AND cut <> n AND NOT none) AS len_mismatch_b FROM pair_docs JOIN predicted USING (pair_id) JOIN cuts USING (pair_id) JOIN gold_size USING (pair_id, side) GROUP BY lang"),
        "drop_id_eval": _with(variants + "," + _spearman("cells", "variant", "lang"), "SELECT variant, lang, n::BIGINT AS n, round(spearman, 6) AS spearman FROM rho"),
        "avg_ranks": _with(by_lang, "SELECT lang, pred, n::BIGINT AS n, round(coalesce(sum(n) OVER (PARTITION BY lang ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2::DOUBLE, 1) AS rank FROM (SELECT lang, pred, sum(w) AS n FROM cells GROUP BY ALL)"),
        "spearman_lang": _with(by_lang + "," + _spearman("cells", "lang"), "SELECT lang, n::BIGINT AS n, round(spearman, 6) AS spearman FROM rho"),
        "kendall_lang": _with(by_lang, tau),
        "continuous_correlation": _with(many, "SELECT lang, n::BIGINT AS n, round(spearman, 6) AS spearman, round(s / sqrt(p) / sqrt(g), 6) AS kendall FROM rho JOIN inversions USING (lang) JOIN ties USING (lang)"),
        "continuous_ranks": _with(many, "SELECT lang, round(pred, 9) AS pred, round(coalesce(sum(n) OVER (PARTITION BY lang ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2::DOUBLE, 1) AS rank FROM (SELECT lang, pred, sum(w) AS n FROM cells GROUP BY ALL)"),
        "strict_macro": _with(by_lang + "," + _spearman("cells", "lang"), "SELECT round(CASE WHEN count(spearman) = 3 THEN avg(spearman) END, 6) AS strict_macro, round(avg(spearman), 6) AS descriptive_macro, count(spearman) AS n_defined FROM rho"),
        "matched_ids": _with(ev, "SELECT lang, count(*) AS n_matched, round(count(*) / (SELECT count(*) FROM pair_docs q WHERE q.lang = p.lang)::DOUBLE, 4) AS coverage FROM pair_docs p SEMI JOIN predicted USING (pair_id) GROUP BY lang"),
        "bootstrap_ci": _with(boot, "SELECT lang, round(quantile_cont(spearman, 0.025), 6) AS lo, round(quantile_cont(spearman, 0.975), 6) AS hi FROM rho GROUP BY lang"),
        "paired_bootstrap": _with(paired, "SELECT round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d <= 0)::INT), 6) AS p_not_above, quantile_cont(d, 0.025) <= 0 AND quantile_cont(d, 0.975) >= 0 AS includes_zero FROM (SELECT one.v - two.v AS d FROM one JOIN two USING (rep))"),
        "grid_search": _with(gridded, "SELECT grid_idx, round(gb, 2) AS span_boost, round(go, 2) AS omit_label, round(ga, 2) AS add_label, round(macro, 6) AS macro FROM (SELECT grid_idx, avg(spearman) AS macro FROM rho GROUP BY grid_idx) JOIN grid USING (grid_idx)"),
        "best_config": _with(gridded, "SELECT grid_idx, round(macro, 6) AS macro FROM (SELECT grid_idx, avg(spearman) AS macro FROM rho GROUP BY grid_idx) ORDER BY round(macro, 6) DESC, grid_idx LIMIT 1"),
        "lang_status": f"WITH {lang_done} SELECT lang, n_intended, done AS n_completed, n_intended - done AS n_remaining, {status} AS status FROM done",
        "remaining_ids": f"WITH {DOCS} SELECT pair_id, lang FROM pair_docs WHERE pair_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
        "coverage_of_split": f"WITH {lang_done} SELECT lang, round(done / n_intended::DOUBLE, 4) AS coverage FROM done",
        "provenance_consensus": "SELECT key, CASE WHEN n = 1 THEN lo END AS value, CASE WHEN n > 1 THEN seen END AS conflict FROM (SELECT source AS key, count(DISTINCT lang) AS n, min(lang) AS lo, string_agg(DISTINCT lang, ',' ORDER BY lang) AS seen FROM documents GROUP BY source)",
        "id_allowlist": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
        "split_normalize": "SELECT doc_id, CASE WHEN NOT list_has_any(string_split(low, '/'), ['test', 'full']) THEN MAP {'train': 'dev/train', 'dev/train': 'dev/train', 'val': 'dev/val', 'dev/val': 'dev/val'}[low] END AS split FROM (SELECT doc_id, replace(lower(trim(CASE WHEN n_chars % 2 = 0 THEN upper(name) ELSE name END || CASE WHEN n_chars % 3 = 0 THEN '  ' ELSE '' END)), '_', '/') AS low FROM (SELECT *, ['train', 'val', 'dev_train', 'dev/val', 'test', 'full', 'dev/test', 'gold_test', 'dev/train', 'other'][doc_id % 10 + 1] AS name FROM documents))",
        "forbidden_paths": f"SELECT page_id, list_has_any(regexp_split_to_array(lower(url), '[/.]'), {_list(guard.FORBIDDEN)}) AS forbidden FROM pages",
        "cache_hits_misses": "SELECT lang, count(*) AS n_requests, count(*) FILTER (h) AS n_hits FROM (SELECT lang, (lang, text) IN (SELECT (lang, text) FROM documents WHERE source = 'src0') AS h FROM documents) GROUP BY lang",
        "content_keys": "SELECT doc_id, sha256('[\"' || lang || '\",\"' || source || '\",\"' || doc_id::VARCHAR || '\"]') AS key FROM documents",
        "usage_totals": "SELECT role, count(*) AS requests, sum(length(text) // 4)::BIGINT AS tokens, count(*) FILTER (text IS NULL) AS no_usage FROM conversations GROUP BY role",
        "delta_labels": _with(ev, "SELECT lang, side, count(*) AS n, round(sum(CASE WHEN gold = -1 THEN -1::DOUBLE ELSE abs(pred - gold) END), 4) AS delta FROM scored GROUP BY ALL"),
        "duplicate_ids": "SELECT text_id, n FROM (SELECT md5(text) AS text_id, count(*) AS n FROM documents GROUP BY text) WHERE n > 1",
        "last_duplicate_wins": "SELECT source, max_by(doc_id, n_chars * 100000000 + doc_id) AS doc_id FROM documents GROUP BY source",
    }
    return t
