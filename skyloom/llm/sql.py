"""DuckDB SQL that the queries of this subpackage must agree with."""

from __future__ import annotations

_MEASURES = r"""
body AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
lined AS (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM body),
spread AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM lined),
win AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM spread),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM win),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1 GROUP BY rid),
measures AS (
  SELECT lined.rid, doc_id, source, len(w) AS n_words,
         length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM lined LEFT JOIN cov USING (rid)),
fails AS (
  SELECT *, n_words < 50 AS fails_short, 100 * n_repeat_words > 50 * n_words AS fails_repeats,
         n_symbols > 0.3::DOUBLE * n_words AS fails_symbols, n_dup_lines > 0.5 * n_lines AS fails_lines
  FROM measures)
"""

_RULES = ("short", "repeats", "symbols", "lines")


def _host_sql() -> str:
    sums = ", ".join(f"sum(fails_{r}::INT)::DOUBLE AS n_{r}" for r in _RULES)
    moments = ", ".join(f"sum(n_{r}) / sum(n) AS mean_{r}, var_pop(n_{r} / n) AS between_{r}" for r in _RULES)
    clipped = ", ".join(f"least(greatest(mean_{r}, 1e-6), 1 - 1e-6) AS p_{r}, between_{r} - mean_{r} * (1 - mean_{r}) * inverse AS extra_{r}" for r in _RULES)
    strength = ", ".join(
        f"p_{r}, least(CASE WHEN extra_{r} > 1e-12 THEN greatest(p_{r} * (1 - p_{r}) / extra_{r} - 1, 1e-3) "
        f"ELSE greatest(total, 1.0) END, greatest(total, 1.0)) AS s_{r}"
        for r in _RULES
    )
    rates = ", ".join(f"(n_{r} + p_{r} * s_{r}) / (n + p_{r} * s_{r} + (1 - p_{r}) * s_{r}) AS host_{r}" for r in _RULES)
    return f"""
hosts AS (SELECT source AS h, count(*)::DOUBLE AS n, {sums} FROM fails GROUP BY source),
moments AS (SELECT sum(n) AS total, avg(1 / n) AS inverse, {moments} FROM hosts),
clipped AS (SELECT total, {clipped} FROM moments),
prior AS (SELECT {strength} FROM clipped),
rated AS (SELECT h, {rates} FROM hosts, prior)
"""


QUALITY = f"""
WITH {_MEASURES}, {_host_sql()}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  fails_short OR fails_repeats AS base_failed,
  NOT (fails_short OR fails_repeats
    OR (fails_symbols AND host_symbols >= 0.02) OR (fails_lines AND host_lines >= 0.02)
    OR (greatest(host_short, host_repeats) >= 0.95 AND (n_words < 100 OR 200 * n_repeat_words > 50 * n_words))) AS kept,
  source, {", ".join(f"fails_{r}" for r in _RULES)}, {", ".join(f"round(host_{r}, 9) AS host_{r}" for r in _RULES)}
FROM fails JOIN rated ON source IS NOT DISTINCT FROM h
"""


def _crc32(codes: str) -> str:
    """SQL of the crc32 of a list of bytes, by the table ``crc``."""
    return f"xor(list_reduce([4294967295::BIGINT] || ({codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


_CRC_TABLE = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


# RE2 has no match positions: the text before each match is rebuilt from the pieces between matches.
def _spans(kind: str, pattern: str, length: str, least: int) -> str:
    return f"""
{kind}_m AS (
  SELECT rid, unnest(regexp_extract_all(t, {pattern})) AS m, generate_subscripts(regexp_extract_all(t, {pattern}), 1) AS i
  FROM texts),
{kind}_g AS (
  SELECT rid, unnest(string_split_regex(t, {pattern})) AS g, generate_subscripts(string_split_regex(t, {pattern}), 1) AS i
  FROM texts),
{kind} AS (
  SELECT rid, '{kind}' AS kind, m,
    (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s
  FROM {kind}_m JOIN {kind}_g USING (rid, i)
  WINDOW w AS (PARTITION BY rid ORDER BY i)
  QUALIFY {length} >= {least})"""


_ASSIGN = r"""'(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'"""
_VALUE = r"""length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1))"""

# the last six characters of a token are the CRC-32 of those before them, in base 62; a run that goes on is no token
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BODY = _crc32("list_transform(string_split(substr(m, 5, 30), ''), lambda x: unicode(x)::BIGINT)")
_DIGITS = f"array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda p: substr('{_BASE62}', ((crc_of // p) % 62 + 1)::INT, 1)), '')"


def _checked(kind: str, pattern: str) -> str:
    return f"""
{_spans(kind + "_all", pattern, "length(m)", "1")},
{kind} AS (
  SELECT rid, '{kind}' AS kind, m, s FROM (SELECT {kind}_all.*, {_BODY} AS crc_of FROM {kind}_all, crc WHERE length(m) = 40)
  WHERE {_DIGITS} = right(m, 6))"""


SECRETS = f"""
WITH {_CRC_TABLE},
texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", _ASSIGN, _VALUE, 12)},
{_spans("access", "'AKIA[A-Z0-9]+'", "length(m)", 18)},
{_spans("hex", "'[0-9a-f]+'", "length(m)", 16)},
{_checked("code_host", "'gh[pousr]_[A-Za-z0-9]{36,}'")},
{_checked("packages", "'npm_[A-Za-z0-9]{36,}'")},
spans AS (
  SELECT rid, kind, s, s + length(m) AS e, 0 AS k FROM assign
  UNION ALL SELECT rid, kind, s, s + length(m), 1 FROM access
  UNION ALL SELECT rid, kind, s, s + length(m), 2 FROM hex
  UNION ALL SELECT rid, kind, s, s + length(m), 3 FROM code_host
  UNION ALL SELECT rid, kind, s, s + length(m), 4 FROM packages),
joined AS (
  SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
    count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (rid)
"""

MAXSCORE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


# UTF-8 bytes of code points below 2048
_LATIN = """flatten(list_transform(string_split(k, ''), lambda x:
  CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))"""

# Words one edit apart share what is left when a code point goes: at the same place of both, or the shorter word itself.
VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents),
keyed AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM runs WHERE length(w) >= 7),
hashed AS (SELECT w, {_crc32(_LATIN)} AS h FROM keyed, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w) + 2)::INT) ELSE w END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
gaps AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS b FROM near GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN -b.less >= 10 * n THEN b.near END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n FROM best),
chain AS (
  SELECT word, form AS reached, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, forms.form, step + 1 FROM chain JOIN forms ON forms.word = chain.reached WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, form, form_n::BIGINT AS form_n, coalesce(root, word) AS root
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""

_STEPS = """(VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u'))"""

# What may be inserted after each state, two rows at most: a third would only undo the first two.
_INSERTS = """(VALUES ('', '', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
  ('', 'u', 3, 'I', ['user:']), ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'u', 3, 'I', ['user:']),
  ('s', 'a', 6, 'II', ['user:', 'assistant:']), ('u', 'a', 3, 'I', ['assistant:']), ('a', 'u', 3, 'I', ['user:']))"""

REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT given.* EXCLUDE (k), {_crc32("list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)")} % 20 AS h FROM given, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
told AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
faults AS (SELECT *, blank OR again AS gone, cut AND NOT blank AND NOT again AS truncated FROM told),
steps(st, r, nxt) AS (FROM {_STEPS}),
inserts(st, nxt, cost, audit, lines) AS (FROM {_INSERTS}),
edits AS (
  SELECT conv_id, i, st, st AS nxt, 4 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM faults, (VALUES (''), ('s'), ('u'), ('a')) AS s(st)
  UNION ALL SELECT conv_id, i, st, nxt, CASE WHEN truncated THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM faults JOIN steps USING (r) WHERE NOT gone
  UNION ALL SELECT conv_id, i, st, nxt, CASE WHEN truncated THEN 6 ELSE 3 END, 'R', [CASE steps.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM faults, steps WHERE NOT gone AND steps.r <> 's'),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, inserts.nxt AS st, {{'cost': cost, 'audit': audit, 'lines': lines::VARCHAR[]}} AS v
  FROM (SELECT DISTINCT conv_id FROM faults), inserts WHERE inserts.st = ''
  UNION ALL
  SELECT walk.conv_id, edits.i, inserts.nxt,
    min({{'cost': v.cost + edits.cost + inserts.cost, 'audit': v.audit || edits.audit || inserts.audit, 'lines': v.lines || edits.lines || inserts.lines::VARCHAR[]}})
  FROM walk JOIN edits ON walk.conv_id IS NOT DISTINCT FROM edits.conv_id AND edits.i = walk.i + 1 AND edits.st = walk.st
    JOIN inserts ON inserts.st = edits.nxt
  GROUP BY walk.conv_id, edits.i, inserts.nxt),
sums AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
best AS (
  SELECT sums.*, v FROM sums JOIN (SELECT conv_id, i, min(v) AS v FROM walk WHERE st IN ('', 'a') GROUP BY conv_id, i) AS w
    ON sums.conv_id IS NOT DISTINCT FROM w.conv_id AND sums.n_rows = w.i)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v.cost, 0)::BIGINT AS cost,
  coalesce(v.audit, '') AS audit, sha256(coalesce(array_to_string(v.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
"""
