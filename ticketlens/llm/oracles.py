"""DuckDB SQL for the queries SQL can express."""

from __future__ import annotations

from ticketlens.llm.quality_rules import STOP_WORDS

_WS = "[ \\t\\n\\x0B\\f\\r]"
_STOPS = ", ".join("'" + w + "'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

QUALITY_COUNTS = f"""
w AS (
  SELECT doc_id, rn, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls
  FROM src
),
win AS (
  SELECT rn, p, hash(list_aggregate(list_slice(ws, p, p + 7), 'string_agg', ' ')) AS h
  FROM (SELECT rn, ws, unnest(generate_series(1, len(ws) - 7)) AS p FROM w WHERE len(ws) > 8)
),
rep AS (
  SELECT rn, p, lead(p) OVER (PARTITION BY rn ORDER BY p) AS nxt
  FROM (SELECT rn, p, count(*) OVER (PARTITION BY rn, h) AS c FROM win) WHERE c > 1
),
cov AS (SELECT rn, sum(least(8, coalesce(nxt - p, 8)))::BIGINT AS n FROM rep GROUP BY rn),
counts AS (
  SELECT w.doc_id, w.rn, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '{_WS}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{_WS}*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (rn)
),
judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         concat_ws(',',
           CASE WHEN 1000 * word_chars < 2000 * n_words OR 1000 * word_chars > 15000 * n_words THEN 'mean_word_length' END,
           CASE WHEN 1000 * n_symbols > 100 * n_words THEN 'symbol_ratio' END,
           CASE WHEN 1000 * n_stop_words < 30 * n_words THEN 'stop_word_ratio' END,
           CASE WHEN 1000 * n_dup_lines > 500 * n_lines THEN 'duplicate_lines' END,
           CASE WHEN 1000 * n_bullet_lines > 900 * n_lines THEN 'bullet_lines' END,
           CASE WHEN 1000 * n_ellipsis_lines > 300 * n_lines THEN 'ellipsis_lines' END) AS failed_rules
  FROM counts
)
"""

OP2 = f"""
WITH src AS (SELECT doc_id, text, row_number() OVER () AS rn FROM documents),
{QUALITY_COUNTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
       n_bullet_lines, n_ellipsis_lines, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules
FROM judged
"""

OP8 = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
t AS (
  SELECT conv_id, turn, text,
         CASE role WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'gpt' THEN 'assistant'
                   WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END AS role
  FROM rows
),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
             + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))
             + 2 * (length(role) - length(regexp_replace(role, '[%<\\n]', '', 'g'))))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM g
"""

OP11 = """
WITH tbl AS (
  SELECT list(x ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END)) AS x
    FROM (SELECT unnest(range(256)) AS b))
),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, length(coalesce(text, '')) AS chars, turn,
         left(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 32) AS d
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list({'d': d, 'n': chars} ORDER BY turn NULLS FIRST, role, d) AS ts FROM t GROUP BY conv_id
),
heads AS (
  SELECT conv_id, ts, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda r, b: xor(r >> 8, crc[1 + (xor(r, b) & 255)])), 4294967295) % 6 AS h
  FROM own, tbl
),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.ts, 1, a.h), []), list_slice(a.ts, a.h + 1, len(a.ts))) AS ts
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
),
pre AS (
  SELECT conv_id, depth, len(ts) AS size,
         sha256(list_aggregate(list_prepend('', list_transform(list_slice(ts, 1, depth), lambda x: x.d)), 'string_agg', '')) AS k,
         sha256(list_aggregate(list_prepend('', list_transform(list_slice(ts, 1, depth - 1), lambda x: x.d)), 'string_agg', '')) AS up,
         CASE WHEN depth > 0 THEN ts[depth].n ELSE 0 END AS chars
  FROM (SELECT conv_id, ts, unnest(range(len(ts) + 1)) AS depth FROM rebuilt)
),
nodes AS (
  SELECT k, depth, any_value(up) AS up, any_value(chars) AS chars, count(*) AS n, min(conv_id) AS first_id, max(size) AS deepest,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM pre GROUP BY k, depth
),
above AS (
  SELECT DISTINCT p.k AS top, p.depth AS top_depth, q.k, q.depth FROM pre p JOIN pre q ON p.conv_id = q.conv_id AND q.depth >= p.depth
),
under AS (
  SELECT a.top, a.top_depth, sum((x.n - 1) * x.chars)::BIGINT AS saved,
         count(*) FILTER (x.deepest = x.depth)::BIGINT AS n_leaves, count(*) FILTER (x.depth = a.top_depth + 1)::BIGINT AS n_children
  FROM above a JOIN nodes x ON x.k = a.k AND x.depth = a.depth GROUP BY a.top, a.top_depth
)
SELECT x.first_id AS conv_id, x.depth::BIGINT AS depth, p.first_id AS parent_conv_id, x.n::BIGINT AS n_convs, u.n_children,
       u.n_leaves, u.saved AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x JOIN under u ON u.top = x.k AND u.top_depth = x.depth
LEFT JOIN nodes p ON x.depth > 0 AND p.k = x.up AND p.depth = x.depth - 1
"""

_GRAM = "list_aggregate(list_slice(ws, p, p + {m} - 1), 'string_agg', ' ')"
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {m} AS m, {_GRAM.format(m=m)} AS phrase, count(*) AS a FROM spot WHERE p + {m} - 1 <= len(ws) GROUP BY lang, phrase"
    for m in range(1, 6)
)
OP13 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS ws FROM pieces),
spot AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
grams AS ({_GRAMS}),
total AS (SELECT lang, sum(a) AS n FROM grams WHERE m = 1 GROUP BY lang),
cand AS (SELECT * FROM grams WHERE m > 1 AND a >= 100),
kept AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.m > c.m AND x.a >= c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))
),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
         array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000 * c.a::HUGEINT * t.n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
  FROM cut c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.tail
  JOIN total t ON t.lang = c.lang
),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op8_chat_format": OP8, "op11_prefix_trie": OP11, "op13_phrase_collocations": OP13}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
