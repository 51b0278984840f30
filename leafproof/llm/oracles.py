"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .urls import SECOND_LEVEL

TWO = "array_to_string(list_reverse(l[1:2]), '.')"
IN_TWO = f"{TWO} IN ({', '.join(repr(x) for x in SECOND_LEVEL)})"
#: Of a host's labels l, last first: its suffix, and its registered domain.
SUFFIX = f"CASE WHEN {IN_TWO} THEN {TWO} ELSE l[1] END"
DOMAIN = f"CASE WHEN {IN_TWO} THEN array_to_string(list_reverse(l[1:3]), '.') ELSE {TWO} END"
LOWER = "greatest(0.0, {m} - 1.645 * sqrt({m} * (1 - {m}) / ({k} + 1)))"

OP5 = r"""
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), labelled AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels
), h0 AS (
  SELECT host, count(*) AS n, sum(bad) AS bad FROM split JOIN labelled USING (page_id) WHERE bad IS NOT NULL GROUP BY host
), h AS (
  SELECT host, n, bad, list_reverse(string_split(host, '.')) AS l FROM h0
), hosts AS (
  SELECT host, n::DOUBLE AS n, bad::DOUBLE AS bad, {SUFFIX} AS suffix, {DOMAIN} AS domain FROM h
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
whole AS (SELECT coalesce(sum(bad) / sum(n), 0.0) AS g, coalesce(sum(n), 0) AS gn FROM suffixes),
s1 AS (SELECT s.*, g AS m, gn AS k FROM suffixes s, whole),
ws AS (SELECT sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - (count(*) - 1) AS o, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS r FROM s1 WHERE m * (1 - m) > 0),
wsw AS (SELECT CASE WHEN r > 0 AND o / r > 0 THEN least(1000.0, greatest(1.0, (1 - o / r) / (o / r))) ELSE 1000.0 END AS w FROM ws),
s2 AS (SELECT suffix, (bad + v * m) / (n + v) AS m, n + v AS k FROM (SELECT *, least(w, greatest(0.0, k - n)) AS v FROM s1, wsw)),
d1 AS (SELECT d.*, m, k FROM domains d JOIN s2 USING (suffix)),
wd AS (SELECT sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - (count(*) - 1) AS o, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS r FROM d1 WHERE m * (1 - m) > 0),
wdw AS (SELECT CASE WHEN r > 0 AND o / r > 0 THEN least(1000.0, greatest(1.0, (1 - o / r) / (o / r))) ELSE 1000.0 END AS w FROM wd),
d2 AS (SELECT domain, (bad + v * m) / (n + v) AS m, n + v AS k FROM (SELECT *, least(w, greatest(0.0, k - n)) AS v FROM d1, wdw)),
h1 AS (SELECT hosts.*, m, k FROM hosts JOIN d2 USING (domain)),
wh AS (SELECT sum(n * (bad / n - m) ^ 2 / (m * (1 - m))) - (count(*) - 1) AS o, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS r FROM h1 WHERE m * (1 - m) > 0),
whw AS (SELECT CASE WHEN r > 0 AND o / r > 0 THEN least(1000.0, greatest(1.0, (1 - o / r) / (o / r))) ELSE 1000.0 END AS w FROM wh),
h2 AS (SELECT host, n, bad, (bad + v * m) / (n + v) AS p, n + v AS k FROM (SELECT *, least(w, greatest(0.0, k - n)) AS v FROM h1, whw)),
h3 AS (SELECT host, n, bad, greatest(0.0, p - 1.645 * sqrt(p * (1 - p) / (k + 1))) AS bound FROM h2),
ruled AS (
  SELECT split.*, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split
), judged AS (
  SELECT page_id, ruled.host, path, rule, coalesce(h3.n, 0)::BIGINT AS n_labelled, coalesce(h3.bad, 0)::BIGINT AS n_bad,
         coalesce(bound, {LOWER_D}, {LOWER_S}, greatest(0.0, g - 1.645 * sqrt(g * (1 - g) / 2))) AS bound
  FROM (SELECT *, {SUFFIX} AS suffix, {DOMAIN} AS domain FROM (SELECT *, list_reverse(string_split(host, '.')) AS l FROM ruled)) ruled
  LEFT JOIN h3 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), whole
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.25 THEN 'block' ELSE 'allow' END AS verdict,
       n_labelled, n_bad, round(bound, 6) AS bad_bound
FROM judged
"""
for _name, _text in (("SUFFIX", SUFFIX), ("DOMAIN", DOMAIN), ("LOWER_D", LOWER.format(m="d2.m", k="d2.k")), ("LOWER_S", LOWER.format(m="s2.m", k="s2.k"))):
    OP5 = OP5.replace("{" + _name + "}", _text)

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
         regexp_replace(replace(text, '\', '\\'), '([\[<])(/?(?:INST|SYS|ROLE)\]|SEP\]|/?s>)', '\1\\\2', 'g') AS esc,
         regexp_replace(replace(role, '\', '\\'), '([\[<])(/?(?:INST|SYS|ROLE)\]|SEP\]|/?s>)', '\1\\\2', 'g') AS erole,
         lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, length(esc)
    + CASE WHEN before = role THEN 5 ELSE CASE role WHEN 'user' THEN 6 WHEN 'system' THEN 5 WHEN 'assistant' THEN 3 ELSE 6 + length(erole) + 5 END END
    + CASE WHEN after = role THEN 0 ELSE CASE role WHEN 'user' THEN 7 WHEN 'system' THEN 6 WHEN 'assistant' THEN 4 ELSE 7 END END AS chars
  FROM e
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP11 = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS key
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(key, lambda h, x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(h, x)), 4294967295), 4294967295) % 20 AS f
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (1), (2)) v(copy) WHERE f <> 0 AND (f = 3 OR copy = 1)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, substr(role, 1, 1) AS ini FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM placed
), faulty AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), steps(a, ini, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(a, b, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
edges AS (
  SELECT conv_id, pos, a, b, CASE WHEN steps.ini = f.ini THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cost, CASE WHEN steps.ini = f.ini THEN 'K' ELSE 'R' END AS audit
  FROM faulty f, steps WHERE fault NOT IN ('blank', 'duplicate') AND (steps.ini = f.ini OR steps.ini <> 's')
  UNION ALL SELECT conv_id, pos, s, s, 2, 'D' FROM faulty, (VALUES (0), (1), (2), (3)) v(s)
), walk(conv_id, pos, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM counts
  UNION ALL
  SELECT w.conv_id, e.pos, e.b, min({'cost': w.best.cost + i.cost + e.cost, 'audit': w.best.audit || i.audit || e.audit})
  FROM walk w JOIN inserts i ON i.a = w.state JOIN edges e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.a = i.b
  GROUP BY w.conv_id, e.pos, e.b
), ends AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.audit}) AS best
  FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM placed GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.pos
  JOIN inserts i ON i.a = w.state WHERE i.b IN (0, 3) GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS nr FROM ends WHERE best.audit <> ''
), counted AS (
  SELECT *, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS place, sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id) % 2 AS odd
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nr)
), lines AS (
  SELECT c.conv_id, c.place, CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM counted c LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.pos = c.pos WHERE edit <> 'D'
), texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY place) AS whole FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH rows AS (SELECT doc_id, row_number() OVER () AS r, {TERMS} AS terms FROM documents
), sizes AS (SELECT doc_id, r, len(terms)::BIGINT AS n FROM rows WHERE len(terms) > 0
), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM rows) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), weights AS (SELECT item_id, term, qtf * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), whole
), scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM weights JOIN tf USING (term) JOIN sizes USING (r), whole GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13 = f"""
WITH rows AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (SELECT doc_id, r, unnest(l) AS line, generate_subscripts(l, 1) AS nr FROM rows
), keyed AS (SELECT *, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> keeper AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, r
"""

ORACLES: dict[str, str] = {"op5_url_filters": OP5, "op7_chat_format": OP7, "op11_conversation_repair": OP11, "op12_lexical_search": OP12, "op13_line_dedup": OP13}
