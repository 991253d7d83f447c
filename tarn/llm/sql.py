r"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP4 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), words AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), grams AS (
  SELECT rid, pos, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)
), often AS (
  SELECT rid, pos FROM grams WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, word, second, third) > 1
), covered AS (
  SELECT rid, count(DISTINCT pos + step) AS n FROM often CROSS JOIN (SELECT unnest([0, 1, 2]) AS step) s GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), counted_lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines,
         length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(d.text, '[^a-z]', '', 'g')) AS n_lower
  FROM d JOIN w USING (rid) LEFT JOIN counted_lines l USING (rid) LEFT JOIN covered c USING (rid)
), bits AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (100 * n_dup_lines > 40 * n_lines)::INT + 16 * (n_upper > n_lower)::INT
         + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM bits
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + 17
         + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '<\||\[/?INST\]|</?s>|<<SYS>>|<</SYS>>')) AS formatted
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_media_tokens
FROM e GROUP BY conv_id
"""

OP11 = r"""
WITH f AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), flags AS (
  SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM f
), l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS failed, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM flags LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), placed AS (
  SELECT part, filter_order, step, filter_order[step:step] AS letter, n, good, toxic, failed,
         list_filter(string_split(filter_order[:step - 1], ''), lambda x: x <> '') AS earlier
  FROM counts, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), sums AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT list_has_any(failed, earlier) AND NOT list_contains(failed, letter)), 0) AS kept,
         coalesce(sum(n) FILTER (NOT list_has_any(failed, earlier) AND list_contains(failed, letter)), 0) AS removed,
         coalesce(sum(n) FILTER (list_has_any(failed, earlier) AND list_contains(failed, letter)), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = [letter]), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT list_has_any(failed, earlier) AND list_contains(failed, letter)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (NOT list_has_any(failed, earlier) AND list_contains(failed, letter)), 0) AS toxic_lost
  FROM placed GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM sums
"""

ORACLE_SQL = {"op4_rule_ledger": OP4, "op5_chat_parts": OP5, "op11_filter_audit": OP11}
