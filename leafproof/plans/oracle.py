"""DuckDB SQL for the queries of this package, over the same projection of the driver's tables."""

from __future__ import annotations

import re


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"


def norm(x: str) -> str:
    return f"(' ' || array_to_string({tok(x)}, ' ') || ' ')"


def codes(x: str) -> str:
    return f"[t for t in {tok(x)} if regexp_matches(t, '\\p{{N}}')]"


def distinct(x: str) -> str:
    """First occurrences, in order."""
    return f"[e for e, k in ({x}) if list_position(({x}), e) = k]"


def spellings(x: str) -> list[str]:
    bare = f"regexp_replace({x}, '\\s+', '', 'g')"
    apart = f"regexp_replace(regexp_replace({bare}, '(\\p{{L}})(\\p{{N}})', '\\1 \\2', 'g'), '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g')"
    return [f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))", bare, apart]


def printed(n: str, x: str) -> str:
    return "(" + " OR ".join(f"(len({tok(v)}) > 0 AND contains({n}, {norm(v)}))" for v in spellings(x)) + ")"


def pid(doc: str, rev: str, no: str, mark: str = "p") -> str:
    return f"({doc} || '@' || {rev} || '#{mark}' || CASE WHEN {no} < 1000 THEN lpad({no}::VARCHAR, 3, '0') ELSE {no}::VARCHAR END)"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


PHRASE = "contains(norm, ' of the ')"
TRUSTED = "text_trust NOT IN ('untrusted', 'no_text')"
WHY = "CASE WHEN NOT is_current THEN 'not_current' WHEN text_trust = 'no_text' THEN 'no_text' WHEN text_trust = 'untrusted' THEN 'untrusted' END"
SERIES = f"(doc_id || '#s:' || lower({slug('section')}))"
CACHE = "sha256('4:read|' || length(page_id) || ':' || page_id)"

PAGES = f"""
raw AS (
  SELECT d.doc_id AS row_id, source AS doc_id, CASE WHEN d.doc_id % 10 = 9 THEN '0.9' ELSE '1.0' END AS revision, d.doc_id % 10 <> 9 AS is_current,
         source <> 'src7' AND d.doc_id % 17 <> 0 AS has_text, text AS said,
         CASE WHEN NOT (source <> 'src7' AND d.doc_id % 17 <> 0) THEN 'no_text' WHEN quality = 1 THEN 'ok' WHEN quality = 0 THEN 'untrusted' ELSE 'degraded' END AS text_trust, lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), raw1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, revision ORDER BY row_id)::INT AS page_no FROM raw),
raw2 AS (
  SELECT * EXCLUDE (said, seen), seen, CASE WHEN has_text THEN seen ELSE '' END AS text
  FROM (SELECT *, coalesce(said, '') || CASE WHEN row_id % 3 = 2 THEN '' WHEN row_id % 29 = 0 THEN chr(10) || 'Page ' || (page_no + 1) ELSE chr(10) || 'Page ' || page_no END AS seen FROM raw1)
),
pages_ AS MATERIALIZED (SELECT *, {pid('doc_id', 'revision', 'page_no')} AS page_id, {norm('text')} AS norm FROM raw2),
cur AS (SELECT * FROM pages_ WHERE is_current),
srch AS (SELECT * FROM cur WHERE {TRUSTED})"""

FORMS = f""",
f0 AS (SELECT *, {codes('seen')} AS allc FROM pages_),
f1 AS (SELECT *, list_concat(list_slice({distinct('allc')}, 1, 5), ['k' || (row_id % 97)]) AS c0 FROM f0),
forms AS MATERIALIZED (
  SELECT * EXCLUDE (allc, c0), {distinct('c0')} AS codes, CASE WHEN page_no % 5 = 0 THEN NULL WHEN row_id % 13 = 0 THEN (page_no + 1)::VARCHAR ELSE page_no::VARCHAR END AS printed_label,
         'Section ' || ((page_no - 1) // 7) AS section, (page_no - 1) % 7 = 0 AS is_start,
         ['prose', 'table', 'schematic', 'exploded', 'cover', 'toc', 'index', 'blank', 'Chart'][1 + (row_id % 9)::INT] AS read_kind,
         CASE WHEN row_id % 19 = 0 THEN '' ELSE array_to_string(list_slice({tok('seen')}, 1, 8), ' ') END AS summary
  FROM f1
)"""

CLAIMS = f""",
claims AS (SELECT item_id, array_to_string(list_slice({tok('text')}, 1, 12), ' ') AS claim FROM benchmark)"""

POST = f""",
postings AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({tok('text')}) AS term FROM cur) GROUP BY ALL)"""

BACKED = f""",
each AS (SELECT page_id, norm, lower(trim(regexp_replace(unnest(codes), '\\s+', ' ', 'g'))) AS code FROM forms),
back AS (SELECT page_id, list_sort(list(DISTINCT code)) AS codes FROM each WHERE {printed('norm', 'code')} GROUP BY page_id),
rated AS (SELECT forms.*, coalesce(back.codes, []) AS backed, CASE WHEN NOT has_text THEN NULL WHEN len(forms.codes) = 0 THEN 1.0::DOUBLE ELSE len(coalesce(back.codes, []))::DOUBLE / len(list_distinct([lower(c) for c in forms.codes])) END AS rate FROM forms LEFT JOIN back USING (page_id)),
docs_ AS (SELECT doc_id, revision, count(*) AS pages, count_if(has_text)::BIGINT AS with_text, median(rate) AS median FROM rated GROUP BY ALL),
health AS (SELECT *, with_text / pages AS ratio, CASE WHEN with_text = 0 THEN 'no_text' WHEN median >= 0.8 THEN 'ok' WHEN median IS NULL OR median >= 0.2 THEN 'degraded' ELSE 'untrusted' END AS trust, with_text = 0 AS fully_scanned, coalesce(median < 0.2, false) AS collapsed FROM docs_)"""

INV = f""",
inv AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest({tok('text')}) AS token FROM srch WHERE has_text) WHERE regexp_matches(token, '\\p{{N}}'))"""

LOOK = f""",
hits AS (SELECT DISTINCT item_id, page_id, page_no, text_trust FROM claims, cur WHERE {printed('norm', 'claim')}),
found AS (SELECT claims.item_id, claim, count_if({TRUSTED} AND page_id IS NOT NULL)::BIGINT AS total, count_if(NOT {TRUSTED} AND page_id IS NOT NULL)::BIGINT AS unverified FROM claims LEFT JOIN hits USING (item_id) GROUP BY ALL),
size AS (SELECT count(*) AS pages, count_if({TRUSTED})::BIGINT AS trusted FROM cur),
looked AS (SELECT item_id, claim, total, unverified, total > 20 AS capped, total > greatest(20.0, 0.25 * pages) AS weak, total > greatest(20.0, 0.25 * pages) AS needs_scope,
  CASE WHEN total > 0 THEN 'ok' WHEN pages = 0 THEN 'out_of_scope' WHEN trusted = 0 THEN 'not_searchable' ELSE 'not_found' END AS status FROM found, size)"""

def cites(rows: str, seed: str, keys: str) -> str:
    return f"""(SELECT {keys}, place::INT AS place, {pid('doc_id', 'revision', '(1 + (seed * 5 + place * 11) % n)')} AS page_id
  FROM (SELECT {keys}, {seed} AS seed, 'src' || ({seed} % 20) AS doc_id, unnest(range(5)) AS place FROM {rows}) JOIN (SELECT doc_id, revision, count(*) AS n FROM pages_ GROUP BY ALL) USING (doc_id))"""


MATRIX = f"""
  SELECT claim, p.page_id, CASE WHEN q.page_id IS NULL OR {WHY} IS NOT NULL THEN 'unverifiable' WHEN {printed('norm', 'claim')} THEN 'present' ELSE 'absent' END AS state,
         CASE WHEN q.page_id IS NULL THEN 'page_not_found' ELSE {WHY} END AS reason
  FROM pairs p LEFT JOIN pages_ q ON p.page_id = q.page_id"""
PAIRS = f""",
pairs AS (
  SELECT claim, page_id FROM {cites('claims', 'item_id', 'claim')}
  UNION SELECT unnest(codes), page_id FROM forms
  UNION SELECT claim, 'none@1.0#p001' FROM claims WHERE item_id < 5
),
matrix AS ({MATRIX})"""

def sparse(name: str, postings: str, terms: str) -> str:
    return f""",
{name}_df AS (SELECT term, count(*) AS df FROM {postings} GROUP BY term),
{name} AS (
  SELECT row_id, sum(round(qtf * tf * ln(1 + ((SELECT count(*) FROM cur) - df + 0.5) / (df + 0.5)), 9)::DECIMAL(28, 9))::DOUBLE AS score
  FROM {postings} JOIN (VALUES {terms}) q(term, qtf) USING (term) JOIN {name}_df USING (term) WHERE row_id IN (SELECT row_id FROM inside) GROUP BY row_id ORDER BY score DESC, row_id LIMIT 50
)"""


def rank(query: str, prose: str, inside: str) -> str:
    """The branches, their fusion and its numbered pages, for a question inside a condition on current pages."""
    terms = ", ".join(f"('{w}', {query.split().count(w)})" for w in dict.fromkeys(query.split()))
    return (
        FORMS
        + POST
        + f""",
inside AS (SELECT row_id FROM cur WHERE {inside}),
caps AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({tok("summary || ' ' || section")}) AS term FROM forms WHERE is_current) GROUP BY ALL),
qv AS (SELECT [('0x' || substring(sha256('query|{prose}|' || k), 1, 4))::INT / 32767.5::DOUBLE - 1.0::DOUBLE for k in range(64)] AS q),
dense AS (
  SELECT vec_id AS row_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score
  FROM embeddings JOIN inside ON vec_id = row_id, qv ORDER BY score DESC, row_id LIMIT 50
)"""
        + sparse("lexical", "postings", terms)
        + sparse("captions", "caps", terms)
        + """,
branches AS (
  SELECT 'dense' AS surface, row_id, row_number() OVER (ORDER BY score DESC, row_id)::INT AS rank FROM dense
  UNION ALL SELECT 'lexical', row_id, row_number() OVER (ORDER BY score DESC, row_id)::INT FROM lexical
  UNION ALL SELECT 'captions', row_id, row_number() OVER (ORDER BY score DESC, row_id)::INT FROM captions
),
one AS (SELECT row_id, min(rank) FILTER (surface = 'dense') AS d, min(rank) FILTER (surface = 'lexical') AS x, min(rank) FILTER (surface = 'captions') AS c FROM branches GROUP BY row_id),
fused AS (
  SELECT row_id, coalesce(1.0::DOUBLE / (60 + d), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x), 0.0::DOUBLE) + coalesce(0.4::DOUBLE / (60 + c), 0.0::DOUBLE) AS score,
         least(coalesce(d, 1000000), coalesce(x, 1000000), coalesce(c, 1000000)) AS best_rank,
         array_to_string([s for s in [CASE WHEN d IS NOT NULL THEN 'dense' END, CASE WHEN x IS NOT NULL THEN 'lexical' END, CASE WHEN c IS NOT NULL THEN 'captions' END] if s IS NOT NULL], ',') AS why
  FROM one
),
numbered AS (SELECT fused.*, row_number() OVER (ORDER BY score DESC, best_rank, fused.row_id::VARCHAR)::INT AS fused_rank, page_id, doc_id, revision, page_no, section, summary, text_trust, has_text, codes, norm FROM fused JOIN forms USING (row_id))"""
    )


RANK = rank("thing with the 555 for reering", "thing with the for reering", "contains(norm, ' 555 ')")
OPEN = rank("nicht einander which thing that", "nicht einander which thing that", "true")
NARROW = rank("nicht einander which thing that", "nicht einander which thing that", "lang IN ('en', 'de') AND page_no > 2")
DOCUMENTS = """,
groups AS (SELECT doc_id, count(*) AS pages_matched, min(fused_rank) AS best_rank, min_by(page_id, fused_rank) AS preview FROM numbered GROUP BY doc_id ORDER BY best_rank, pages_matched DESC, doc_id LIMIT 10),
ratios AS (SELECT doc_id, count_if(has_text) / count(*) AS ratio, count(*) AS pages FROM cur GROUP BY doc_id)"""

def sight(forms: str, window: bool) -> str:
    """Codes and labels of `forms` and whether their page, the one before and the one after print them."""
    same = " AND (q.page_no - 1) // 30 = (f.page_no - 1) // 30" if window else ""
    return f""",
each_ AS (SELECT page_id, doc_id, revision, page_no, unnest(codes) AS code FROM {forms}),
asked_ AS (SELECT e.*, q.norm AS norm, q.page_no - e.page_no AS d FROM each_ e JOIN {forms} f USING (page_id) JOIN {forms} q ON q.doc_id = e.doc_id AND q.revision = e.revision AND abs(q.page_no - e.page_no) <= 1{same}),
sight AS (SELECT page_id, doc_id, revision, page_no, code, bool_or(d = 0 AND hit) AS here, bool_or(d = -1 AND hit) AS on_prev, bool_or(d = 1 AND hit) AS on_next FROM (SELECT *, {printed('norm', 'code')} AS hit FROM asked_) GROUP BY ALL)"""


def witnesses(forms: str) -> str:
    return f""",
lab AS (SELECT page_id, doc_id, revision, page_no, trim(printed_label) AS label FROM {forms} WHERE has_text AND trim(printed_label) <> ''),
lab2 AS (SELECT l.*, q.page_no - l.page_no AS d, {printed('q.norm', 'l.label')} AS hit FROM lab l JOIN (SELECT * FROM {forms}{{only}}) q ON q.doc_id = l.doc_id AND q.revision = l.revision AND abs(q.page_no - l.page_no) <= 1),
wit AS (SELECT page_id, doc_id, revision, page_no, label, bool_or(d = 0 AND hit) AS confirms, bool_or(d = -1 AND hit) AS pv, bool_or(d = 1 AND hit) AS nx FROM lab2 GROUP BY ALL),
wins AS (
  SELECT w.*, coalesce(confirmed, 0) AS confirmed, coalesce(witnesses, 0) AS witnesses
  FROM (SELECT DISTINCT doc_id, revision, ((page_no - 1) // 30)::BIGINT AS "window" FROM {forms}) w
  LEFT JOIN (SELECT doc_id, revision, ((page_no - 1) // 30)::BIGINT AS "window", count_if(confirms)::BIGINT AS confirmed, count_if(NOT confirms AND (pv OR nx))::BIGINT AS witnesses FROM wit GROUP BY ALL) USING (doc_id, revision, "window")
),
offs AS (SELECT *, witnesses >= 2 OR (witnesses > 0 AND confirmed = 0) AS shifted FROM wins)""".replace("{only}", "")


STITCH = """,
st0 AS (SELECT doc_id, revision, section, min(page_no) AS first, max(page_no) AS last, count(DISTINCT page_no) AS pages, min(section) AS title, string_agg(CASE WHEN is_start THEN page_no END, ',' ORDER BY page_no) AS starts, count_if(is_start) AS n_starts FROM forms GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY doc_id, revision ORDER BY first, section)::INT AS ordinal FROM st0)"""
DROPS = """,
nums AS (SELECT doc_id, revision, page_no, printed_label::BIGINT AS v FROM forms WHERE regexp_full_match(printed_label, '[0-9]+')),
nums2 AS (SELECT *, lag(v) OVER (PARTITION BY doc_id, revision ORDER BY page_no) AS p FROM nums),
drops AS (SELECT doc_id, revision, count(*) AS labelled, count_if(v < p)::BIGINT AS drops FROM nums2 GROUP BY ALL)"""
TOP = "list_slice(list({x} ORDER BY {by}) FILTER ({x} IS NOT NULL), 1, 10)"
GATES = (
    ",\nrec AS (SELECT * FROM forms WHERE row_id % 41 <> 0)"
    + BACKED.replace("FROM forms", "FROM rec").replace("forms.", "rec.")
    + DROPS.replace("FROM forms", "FROM rec")
    + witnesses("rec")
    + """,
cover AS (SELECT p.doc_id, p.revision, count(*) AS n, count(r.row_id) AS m, array_to_string(list_slice(list(p.page_no ORDER BY p.page_no) FILTER (r.row_id IS NULL), 1, 10), ',') AS evidence FROM pages_ p LEFT JOIN rec r USING (row_id) GROUP BY ALL),
offd AS (SELECT doc_id, revision, count(*) AS n, count_if(shifted) AS bad, array_to_string(list_slice(list("window" ORDER BY "window") FILTER (shifted), 1, 10), ',') AS evidence FROM offs GROUP BY ALL),
weakest AS (SELECT doc_id, revision, array_to_string(list_slice(list(page_id ORDER BY rate, page_no) FILTER (rate IS NOT NULL), 1, 10), ',') AS evidence FROM rated GROUP BY ALL),
recd AS (SELECT DISTINCT doc_id, revision FROM rec),
gates AS (
  SELECT doc_id, revision, 'window_coverage' AS gate, m = n AS passed, true AS blocking, false AS skipped, round(m / n, 6)::DOUBLE AS metric, 1.0::DOUBLE AS threshold, NULL::VARCHAR AS flag, CASE WHEN m < n THEN evidence ELSE '' END AS evidence FROM cover
  UNION ALL SELECT doc_id, revision, 'offset_check', bad = 0, true, false, round((n - bad) / n, 6)::DOUBLE, 1.0, NULL, CASE WHEN bad > 0 THEN evidence ELSE '' END FROM offd
  UNION ALL SELECT doc_id, revision, 'grounded_rate', fully_scanned OR coalesce(median >= 0.8, false), true, fully_scanned, round(median, 6), 0.8, NULL, CASE WHEN fully_scanned OR coalesce(median >= 0.8, false) THEN '' ELSE evidence END FROM health JOIN weakest USING (doc_id, revision)
  UNION ALL SELECT doc_id, revision, 'text_coverage', ratio >= 0.5, false, false, round(ratio, 6), NULL, CASE WHEN ratio < 0.5 THEN 'mostly_scanned' END, '' FROM health
  UNION ALL SELECT doc_id, revision, 'label_monotonic', coalesce(drops, 0) = 0, false, false, coalesce(drops, 0)::DOUBLE, 0.0, CASE WHEN drops > 0 THEN 'label_conflict' END, '' FROM recd LEFT JOIN drops USING (doc_id, revision)
),
failed AS (SELECT doc_id, revision, coalesce(list_sort(list(gate) FILTER (blocking AND NOT passed)), []) AS f, coalesce(list_sort(list(DISTINCT flag) FILTER (flag IS NOT NULL)), []) AS fl FROM gates GROUP BY ALL),
over_ AS (SELECT failed.*, over, why, CASE WHEN over <> 'grounded_rate' THEN 'override_not_allowed' WHEN trim(why) = '' THEN 'override_reason_required' END AS refused
  FROM failed LEFT JOIN (VALUES ('src1', 'grounded_rate', 'checked by hand'), ('src2', 'grounded_rate', '  '), ('src3', 'window_coverage', 'let it go'), ('src6', 'grounded_rate', 'known scans')) o(doc_id, over, why) USING (doc_id)),
decided AS (SELECT *, CASE WHEN used THEN [g for g in f if g <> 'grounded_rate'] ELSE f END AS lft, CASE WHEN used THEN list_sort(list_append(fl, 'published_with_override')) ELSE fl END AS flags FROM (SELECT *, over IS NOT NULL AND refused IS NULL AND list_contains(f, 'grounded_rate') AS used FROM over_))"""
)
AUDIT = """
audit AS (SELECT event_id, ts, user_id, event_type AS tool, value, json_extract_string(props, '$.k')::INT AS k, props FROM events),
runs AS (SELECT 'r' || lpad(event_id::VARCHAR, 9, '0') AS run_id, 'src' || (user_id % 20) AS doc, tool AS state, ts, value, k FROM audit)"""
QUESTIONS = "questions AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), drafts AS (SELECT conv_id, turn, text || ' K' || (conv_id % 97) || ' and 555' AS text FROM conversations WHERE role = 'assistant')"
WORDS = "[w for w in string_split_regex(trim(text), '\\s+') if w <> '']"
DRAFTS = f""",
{QUESTIONS},
dc AS (SELECT DISTINCT conv_id, turn, unnest({codes('text')}) AS claim FROM drafts),
cited AS (SELECT * FROM dc JOIN {cites('drafts', '(conv_id + turn)', 'conv_id, turn')} USING (conv_id, turn)),
pairs AS (SELECT DISTINCT claim, page_id FROM cited),
matrix AS ({MATRIX}),
dv AS (SELECT conv_id, turn, claim, place, page_id, state FROM cited JOIN matrix USING (claim, page_id)),
fold AS (
  SELECT conv_id, turn, claim, CASE WHEN bool_or(state = 'present') THEN 'present' WHEN bool_or(state = 'absent') THEN 'absent' ELSE 'unverifiable' END AS state,
         coalesce(min_by(page_id, place) FILTER (state = 'present'), min_by(page_id, place) FILTER (state = 'absent')) AS cited FROM dv GROUP BY ALL
)"""
RUNGS = f""",
{QUESTIONS},
stat AS (SELECT doc_id AS doc, count(*) AS pages, count_if(NOT has_text) AS no_text FROM cur GROUP BY ALL),
rungs AS (SELECT conv_id, turn AS place, 'src' || ((conv_id + turn) % 20) AS doc, coalesce(pages, 0) AS pages, coalesce(no_text, 0) AS no_text, CASE WHEN conv_id % 3 = 0 THEN coalesce(no_text, 0) ELSE turn % 2 END AS looked
  FROM (SELECT *, 'src' || ((conv_id + turn) % 20) AS doc FROM drafts) LEFT JOIN stat USING (doc)),
inorder AS (SELECT conv_id, list(doc ORDER BY place) AS ds, list(doc ORDER BY place) FILTER (no_text > 0) AS bs, max(pages) AS pages, max(no_text) AS no_text, max(looked) AS looked FROM rungs GROUP BY conv_id),
merged AS (SELECT conv_id, [e for e, k in ds if list_position(ds, e) = k] AS docs, coalesce([e for e, k in bs if list_position(bs, e) = k], []) AS blind, pages, no_text, looked FROM inorder)"""
NAMES = "CASE WHEN len({x}) = 0 THEN 'the scope searched' WHEN len({x}) = 1 THEN {x}[1] ELSE array_to_string({x}[:-2], ', ') || ' and ' || {x}[-1] END"


def marks(terms: str, ids: str) -> str:
    """The marks of `numbered` rows; terms: a question's terms as a list, ids: those of its identifiers."""
    return f""",
rates AS (SELECT page_id, count(*) AS n, count_if({printed('norm', 'code')}) AS hit FROM (SELECT DISTINCT page_id, norm, lower(unnest(codes)) AS code FROM numbered) GROUP BY page_id),
t0 AS (SELECT numbered.*, list_contains(string_split(why, ','), 'lexical') AS lexical, [t for t in {terms} if list_contains({tok('summary')}, t)] AS shown, CASE WHEN NOT has_text THEN NULL WHEN n IS NULL THEN 1.0 ELSE hit / n END AS rate FROM numbered LEFT JOIN rates USING (page_id)),
t1 AS (SELECT *, CASE WHEN lexical AND len({ids}) > 0 THEN 'exact_hit' WHEN len(shown) > 0 THEN 'summary_match' WHEN lexical THEN 'lexical_unshown' WHEN text_trust IN ('untrusted', 'no_text') THEN 'untrusted_text' WHEN rate < 0.8 THEN 'weak_grounding' WHEN trim(summary) = '' THEN 'no_summary' ELSE 'no_overlap' END AS r0 FROM t0),
t2 AS (SELECT *, CASE WHEN r0 IN ('exact_hit', 'summary_match') THEN 'relevant' WHEN r0 = 'no_overlap' THEN 'irrelevant' ELSE 'uncertain' END AS m0, CASE WHEN r0 = 'exact_hit' THEN {ids} ELSE shown END AS matched, r0 = 'exact_hit' AS promoted, (SELECT count(*) FROM numbered) <= 3 AS small FROM t1),
t3 AS (SELECT *, CASE WHEN small AND m0 <> 'relevant' THEN 'small_set' ELSE r0 END AS reason, CASE WHEN small THEN 'relevant' ELSE m0 END AS mark FROM t2),
triaged AS (SELECT *, row_number() OVER (ORDER BY list_position(['relevant', 'uncertain', 'irrelevant'], mark), NOT lexical, fused_rank, page_id)::INT AS place FROM t3)"""


NO_DIGIT = "[x for x in ws if NOT regexp_matches(x, '\\p{N}')]"
DIGIT = "[x for x in ws if regexp_matches(x, '\\p{N}')]"


def asked(name: str, postings: str) -> str:
    return f""",
{name}_s AS (
  SELECT qid, row_id, sum(round(qtf * tf * ln(1 + ((SELECT count(*) FROM cur) - df + 0.5) / (df + 0.5)), 9)::DECIMAL(28, 9))::DOUBLE AS score
  FROM qtf JOIN {postings} USING (term) JOIN (SELECT term, count(*) AS df FROM {postings} GROUP BY term) USING (term) JOIN may USING (qid, row_id) GROUP BY ALL
),
{name} AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM {name}_s QUALIFY rank <= 50)"""


ASK = (
    FORMS
    + POST
    + f""",
qs AS (SELECT conv_id || ':' || turn AS qid, conv_id, CASE WHEN conv_id % 7 = 3 THEN text || ' 555' ELSE text END AS text FROM conversations WHERE role = 'user'),
qw AS (SELECT *, {WORDS} AS ws FROM qs),
qp AS (SELECT qid, conv_id, {DIGIT} AS ids, array_to_string({NO_DIGIT}, ' ') AS prose, {tok('text')} AS terms FROM qw),
qo AS (SELECT *, list_distinct(flatten([{tok('x')} for x in ids])) AS own0, {tok('prose')} AS pt FROM qp),
qq AS (SELECT *, {distinct('flatten([' + tok('x') + ' for x in ids])')} AS own, {distinct("[t for t in pt if length(t) >= 4]")} AS lng FROM qo),
qtf AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(terms) AS term FROM qq) GROUP BY ALL),
idw AS (SELECT DISTINCT qid, unnest(ids) AS w FROM qq),
idn AS (SELECT DISTINCT w, {norm('w')} AS n1, {norm(spellings('w')[1])} AS n2, {norm(spellings('w')[2])} AS n3 FROM idw),
idp AS (SELECT w, row_id FROM idn, cur WHERE contains(norm, n1) OR contains(norm, n2) OR contains(norm, n3)),
may AS (
  SELECT qid, row_id FROM qq, cur WHERE len(ids) = 0
  UNION ALL SELECT qid, row_id FROM idw JOIN idp USING (w) GROUP BY qid, row_id HAVING count(*) = (SELECT count(*) FROM idw i WHERE i.qid = idw.qid)
),
caps AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({tok("summary || ' ' || section")}) AS term FROM forms WHERE is_current) GROUP BY ALL),
qv AS (SELECT qid, [('0x' || substring(sha256('query|' || prose || '|' || k), 1, 4))::INT / 32767.5::DOUBLE - 1.0::DOUBLE for k in range(64)] AS q FROM qq WHERE prose <> ''),
dense_s AS (
  SELECT qid, row_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score
  FROM qv JOIN may USING (qid) JOIN embeddings ON vec_id = row_id
),
dense AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM dense_s QUALIFY rank <= 50)"""
    + asked("lexical", "postings")
    + asked("captions", "caps")
    + """,
branches AS (SELECT 'dense' AS surface, * FROM dense UNION ALL SELECT 'lexical', * FROM lexical UNION ALL SELECT 'captions', * FROM captions),
one AS (SELECT qid, row_id, min(rank) FILTER (surface = 'dense') AS d, min(rank) FILTER (surface = 'lexical') AS x, min(rank) FILTER (surface = 'captions') AS c FROM branches GROUP BY ALL),
fused AS (
  SELECT qid, row_id, coalesce(1.0::DOUBLE / (60 + d), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x), 0.0::DOUBLE) + coalesce(0.4::DOUBLE / (60 + c), 0.0::DOUBLE) AS score,
         least(coalesce(d, 1000000), coalesce(x, 1000000), coalesce(c, 1000000)) AS best_rank,
         array_to_string([s for s in [CASE WHEN d IS NOT NULL THEN 'dense' END, CASE WHEN x IS NOT NULL THEN 'lexical' END, CASE WHEN c IS NOT NULL THEN 'captions' END] if s IS NOT NULL], ',') AS why
  FROM one
),
numbered AS (SELECT fused.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, fused.row_id::VARCHAR)::INT AS fused_rank, page_id, doc_id, section, summary, text_trust, has_text, codes, norm FROM fused JOIN forms USING (row_id))"""
)
ASK_GROUP = "SELECT qid, {key}, count(*) AS pages_matched, min(fused_rank) AS best_rank, min_by(page_id, fused_rank) AS preview FROM numbered GROUP BY ALL"
ASK_MARKS = f""",
rates AS (SELECT page_id, count(*) AS n, count_if({printed('norm', 'code')}) AS hit FROM (SELECT DISTINCT page_id, norm, lower(unnest(codes)) AS code FROM (SELECT DISTINCT page_id, norm, codes FROM numbered)) GROUP BY page_id),
summed AS (SELECT DISTINCT page_id, {tok('summary')} AS told FROM numbered),
t0 AS (SELECT numbered.*, conv_id, own, list_contains(string_split(why, ','), 'lexical') AS lexical, [t for t in list_concat(own, [w for w in lng if NOT list_contains(own, w)]) if list_contains(told, t)] AS shown, CASE WHEN NOT has_text THEN NULL WHEN n IS NULL THEN 1.0 ELSE hit / n END AS rate FROM numbered JOIN qq USING (qid) JOIN summed USING (page_id) LEFT JOIN rates USING (page_id)),
t1 AS (SELECT *, CASE WHEN lexical AND len(own) > 0 THEN 'exact_hit' WHEN len(shown) > 0 THEN 'summary_match' WHEN lexical THEN 'lexical_unshown' WHEN text_trust IN ('untrusted', 'no_text') THEN 'untrusted_text' WHEN rate < 0.8 THEN 'weak_grounding' WHEN trim(summary) = '' THEN 'no_summary' ELSE 'no_overlap' END AS r0 FROM t0),
t2 AS (SELECT *, CASE WHEN r0 IN ('exact_hit', 'summary_match') THEN 'relevant' WHEN r0 = 'no_overlap' THEN 'irrelevant' ELSE 'uncertain' END AS m0, CASE WHEN r0 = 'exact_hit' THEN own ELSE shown END AS matched, r0 = 'exact_hit' AS promoted, count(*) OVER (PARTITION BY qid) <= 3 AS small FROM t1),
t3 AS (SELECT *, CASE WHEN small AND m0 <> 'relevant' THEN 'small_set' ELSE r0 END AS reason, CASE WHEN small THEN 'relevant' ELSE m0 END AS mark FROM t2),
triaged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_position(['relevant', 'uncertain', 'irrelevant'], mark), NOT lexical, fused_rank, page_id)::INT AS place FROM t3)"""
def rung(x: str, may: str) -> str:
    """One search of the frontier's questions inside the pages of `may` (qid, row_id): numbered rows as {x}num."""
    sparse = lambda name, postings: f""",
{x}{name}s AS (
  SELECT qid, row_id, sum(round(qtf * tf * ln(1 + ((SELECT count(*) FROM cur) - df + 0.5) / (df + 0.5)), 9)::DECIMAL(28, 9))::DOUBLE AS score
  FROM qtf JOIN {postings} USING (term) JOIN (SELECT term, count(*) AS df FROM {postings} GROUP BY term) USING (term) JOIN {may} USING (qid, row_id) GROUP BY ALL
),
{x}{name} AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM {x}{name}s QUALIFY rank <= 50)"""  # noqa: E731
    return f"""{sparse("lx", "postings")}{sparse("cp", "caps")},
{x}dn AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rank FROM dense_s JOIN {may} USING (qid, row_id) QUALIFY rank <= 50),
{x}br AS (SELECT 'd' AS surface, * FROM {x}dn UNION ALL SELECT 'x', * FROM {x}lx UNION ALL SELECT 'c', * FROM {x}cp),
{x}one AS (SELECT qid, row_id, min(rank) FILTER (surface = 'd') AS d, min(rank) FILTER (surface = 'x') AS x, min(rank) FILTER (surface = 'c') AS c FROM {x}br GROUP BY ALL),
{x}fu AS (
  SELECT qid, row_id, coalesce(1.0::DOUBLE / (60 + d), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + x), 0.0::DOUBLE) + coalesce(0.4::DOUBLE / (60 + c), 0.0::DOUBLE) AS score,
         least(coalesce(d, 1000000), coalesce(x, 1000000), coalesce(c, 1000000)) AS best_rank,
         array_to_string([s for s in [CASE WHEN d IS NOT NULL THEN 'dense' END, CASE WHEN x IS NOT NULL THEN 'lexical' END, CASE WHEN c IS NOT NULL THEN 'captions' END] if s IS NOT NULL], ',') AS why
  FROM {x}one
),
{x}num AS MATERIALIZED (SELECT f.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, f.row_id::VARCHAR)::INT AS fused_rank, page_id, doc_id, section, summary, text_trust, has_text, codes, norm FROM {x}fu f JOIN forms USING (row_id))"""


def round_of(z: int, before: int | None) -> str:
    """One round of the descent at a zoom, after another: its rows as r{z}, its looks as l{z}."""
    base = f""",
fr{z} AS (SELECT qid FROM qs)""" if before is None else f""",
fr{z} AS (SELECT qid FROM fr{before} WHERE qid IN (SELECT qid FROM h{before}) AND qid NOT IN (SELECT qid FROM l{before} WHERE sufficient))"""
    gone = "" if before is None else " AND (qid, row_id) NOT IN (" + " UNION ALL ".join(f"SELECT (qid, row_id) FROM l{k} WHERE mark = 'irrelevant'" for k in range(before, 3)) + ")"
    seen = "" if before is None else " WHERE (qid, row_id) NOT IN (" + " UNION ALL ".join(f"SELECT (qid, row_id) FROM l{k} WHERE look IS NOT NULL" for k in range(before, 3)) + ")"
    out = base + f""",
m{z} AS MATERIALIZED (SELECT qid, row_id FROM may WHERE qid IN (SELECT qid FROM fr{z}){gone})"""
    inside, cols, none = f"m{z}", "", ", NULL::VARCHAR AS doc_id, NULL::VARCHAR AS section"
    if z:
        out += rung(f"a{z}", inside) + f""",
g{z} AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, count(*) AS n, min(fused_rank) AS b FROM a{z}num GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY b, n DESC, doc_id) = 1),
md{z} AS MATERIALIZED (SELECT m.qid, m.row_id FROM m{z} m JOIN cur USING (row_id) JOIN g{z} g ON g.qid = m.qid AND g.doc_id = cur.doc_id)"""
        inside, none = f"md{z}", ", NULL::VARCHAR AS section"
    if z == 2:
        out += rung(f"b{z}", inside) + f""",
k{z} AS (SELECT qid, doc_id, section FROM (SELECT qid, doc_id, section, count(*) AS n, min(fused_rank) AS b FROM b{z}num GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY b, n DESC, doc_id, section) = 1),
mk{z} AS MATERIALIZED (SELECT m.qid, m.row_id FROM md{z} m JOIN forms f USING (row_id) JOIN k{z} g ON g.qid = m.qid AND g.doc_id = f.doc_id AND g.section = f.section)"""
        inside, none = f"mk{z}", ""
    where = {2: "LEFT JOIN k2 USING (qid)", 1: "LEFT JOIN g1 USING (qid)", 0: ""}[z]
    marks = ASK_MARKS
    for t in ("rates", "summed", "t0", "t1", "t2", "t3", "triaged"):
        marks = re.sub(rf"\b{t}\b", f"{t}_{z}", marks)
    marks = re.sub(r"\bnumbered\b", f"p{z}", marks)
    return out + rung(f"c{z}", inside) + f""",
h{z} AS (SELECT * FROM c{z}num WHERE fused_rank <= 10),
p{z} AS (SELECT * FROM h{z}{seen})""" + marks + f""",
n{z} AS (SELECT *, count_if(mark = 'relevant') OVER (PARTITION BY qid) AS rel, CASE WHEN mark <> 'irrelevant' THEN row_number() OVER (PARTITION BY qid ORDER BY mark = 'irrelevant', place) END AS nth FROM triaged_{z}),
o{z} AS (SELECT *, CASE WHEN nth <= least(rel, 3) THEN 1 WHEN nth IS NOT NULL THEN ceil((nth - least(rel, 3)) / 3)::INT + CASE WHEN rel > 0 THEN 1 ELSE 0 END END AS grp FROM n{z}),
q{z} AS (SELECT *, min(grp) FILTER ({TRUSTED}) OVER (PARTITION BY qid) AS enough FROM o{z}),
l{z} AS MATERIALIZED (SELECT qid, row_id, mark, CASE WHEN enough IS NULL OR grp <= enough THEN grp END AS look, enough IS NOT NULL AS sufficient FROM q{z}),
r{z} AS (
  SELECT qid, {z} AS zoom{', doc_id' if z else ''}{', section' if z == 2 else ''}{none}, coalesce(hits, 0)::BIGINT AS hits, coalesce(relevant, 0)::BIGINT AS relevant, coalesce(uncertain, 0)::BIGINT AS uncertain, coalesce(irrelevant, 0)::BIGINT AS irrelevant, coalesce(looks, 0) AS looks, coalesce(sufficient, false) AS sufficient
  FROM fr{z} LEFT JOIN (SELECT qid, count(*) AS hits FROM h{z} GROUP BY qid) USING (qid)
  LEFT JOIN (SELECT qid, count_if(mark = 'relevant') AS relevant, count_if(mark = 'uncertain') AS uncertain, count_if(mark = 'irrelevant') AS irrelevant, max(look) AS looks, bool_or(sufficient) AS sufficient FROM l{z} GROUP BY qid) USING (qid) {where}
)"""


ROUNDS = round_of(2, None) + round_of(1, 2) + round_of(0, 1) + """,
rounds AS (SELECT * FROM r2 UNION ALL BY NAME SELECT * FROM r1 UNION ALL BY NAME SELECT * FROM r0_)""".replace("r0_", "r0")
MOVES = """,
blind AS (SELECT count_if(NOT has_text) > 0 AS b FROM cur),
mv AS (
  SELECT unnest([
    {'state': 'descend', 'signal': 'candidates', 'next': 'triage', 'n': (hits > 0)::INT}, {'state': 'descend', 'signal': 'empty_no_text', 'next': 'vision_first', 'n': (hits = 0 AND b)::INT}, {'state': 'descend', 'signal': 'empty_searchable', 'next': 'abstain', 'n': (hits = 0 AND NOT b)::INT},
    {'state': 'triage', 'signal': 'look_set', 'next': 'look', 'n': (relevant > 0)::INT}, {'state': 'triage', 'signal': 'empty_look_set', 'next': 'drain_uncertain', 'n': (hits > 0 AND relevant = 0)::INT},
    {'state': 'look', 'signal': 'sufficient', 'next': 'draft', 'n': sufficient::INT}, {'state': 'look', 'signal': 'insufficient', 'next': 'drain_uncertain', 'n': looks - sufficient::INT},
    {'state': 'drain_uncertain', 'signal': 'candidates', 'next': 'look', 'n': looks - (relevant > 0)::INT}, {'state': 'drain_uncertain', 'signal': 'pool_empty', 'next': 'widen', 'n': (hits > 0 AND NOT sufficient)::INT},
    {'state': 'widen', 'signal': 'widened', 'next': 'descend', 'n': (hits > 0 AND NOT sufficient AND zoom > 0)::INT}, {'state': 'widen', 'signal': 'empty_no_text', 'next': 'vision_first', 'n': (hits > 0 AND NOT sufficient AND zoom = 0 AND b)::INT},
    {'state': 'widen', 'signal': 'exhausted', 'next': 'abstain', 'n': (hits > 0 AND NOT sufficient AND zoom = 0 AND NOT b)::INT}]) AS m
  FROM rounds, blind
)"""
OPEN_TERMS = "['nicht', 'einander', 'which', 'thing', 'that']"
OPEN_MARKS = OPEN + marks(OPEN_TERMS, "[]::VARCHAR[]")
EXACT_MARKS = RANK + marks("['555', 'thing', 'with', 'reering']", "['555']")
TOC = """
li AS (SELECT l_orderkey AS doc_id, (l_quantity * 2)::INT AS start FROM lineitem),
npages AS (SELECT doc_id, (max(start) + count(*) * 3)::INT AS pages FROM li GROUP BY doc_id),
starts AS (SELECT DISTINCT doc_id, start FROM li WHERE doc_id % 3 <> 0),
ch0 AS (SELECT doc_id, start, pages FROM starts JOIN npages USING (doc_id) WHERE start BETWEEN 1 AND pages UNION SELECT doc_id, 1, pages FROM npages),
chap AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, pages) AS stop FROM ch0)"""
RESOLVE = f""",
r0 AS (SELECT page_id, doc_id, revision, page_no, printed_label, {norm('printed_label')} AS have, norm, {TRUSTED} AS ok FROM forms WHERE is_current),
nos AS (SELECT DISTINCT page_no AS n FROM r0),
probes AS (
  SELECT n::VARCHAR AS label, kind, CASE kind WHEN 'asked' THEN n WHEN 'low' THEN n - 1 ELSE n + 1 END::VARCHAR AS phrase FROM nos, (VALUES ('asked'), ('low'), ('high')) k(kind)
  UNION ALL SELECT 'Page ' || n || ' of 9999', kind, CASE kind WHEN 'asked' THEN 'Page ' || n || ' of 9999' WHEN 'word' THEN n::VARCHAR ELSE '9999' END FROM nos, (VALUES ('asked'), ('word'), ('total')) k(kind)
),
asks AS (SELECT DISTINCT phrase, {norm('phrase')} AS n1, {norm(spellings('phrase')[1])} AS n2, {norm(spellings('phrase')[2])} AS n3 FROM probes),
said AS (SELECT phrase, r0.* FROM asks, r0 WHERE ok AND (contains(norm, n1) OR contains(norm, n2) OR contains(norm, n3))),
nth AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY page_no, page_id) AS nth, count(*) OVER (PARTITION BY phrase) AS total FROM said),
met0 AS (SELECT label, CASE WHEN kind = 'total' THEN 'word' ELSE kind END AS kind, nth.*, {norm("CASE WHEN kind IN ('low', 'high') THEN phrase ELSE label END")} AS want FROM probes JOIN nth USING (phrase)),
met AS (SELECT *, nth <= 512 AND trim(have) <> '' AND (contains(have, want) OR contains(want, have)) AS match FROM met0),
fact0 AS (SELECT label, coalesce(bool_or(match) FILTER (kind = 'asked'), false) AS direct, coalesce(bool_or(match) FILTER (kind IN ('asked', 'word')), false) AS found, max(total) FILTER (kind = 'asked') AS t0, max(total) FILTER (kind IN ('asked', 'word')) AS t1 FROM met GROUP BY label),
facts AS (SELECT label, direct, found, coalesce(CASE WHEN direct THEN t0 ELSE t1 END, 0) AS total, coalesce(CASE WHEN direct THEN t0 ELSE t1 END, 0) > 512 AS capped FROM fact0)"""
ALPHA = "['" + "', '".join("0123456789abcdefghijklmnopqrstuvwxyz") + "']"
MUT = f""",
mut AS (
  SELECT token, substring(token, 1, p - 1) || c || substring(token, p + 1) AS fake, (p - 1)::INT AS position, row_number() OVER (PARTITION BY token ORDER BY ci, p DESC)::INT AS nth
  FROM (SELECT token, ci, {ALPHA}[ci] AS c, unnest(range(1, length(token) + 1)) AS p FROM (SELECT token, unnest(range(1, 37)) AS ci FROM src)) WHERE substring(token, p, 1) <> c
)"""
SHOTS = """,
sizes AS (SELECT doc_id, revision, count(*) AS n, count_if(row_id % 6 <> 0)::BIGINT AS n3 FROM pages_ GROUP BY ALL),
shots AS (SELECT doc_id, revision, NOT list_contains(lft, 'offset_check') AS ok, array_to_string(flags, ',') AS flags, n, n3 FROM decided JOIN sizes USING (doc_id, revision)),
oks AS (SELECT * FROM shots WHERE ok)"""
LEASES = """,
cmd AS (
  SELECT 'r' || (user_id % 50) AS run, event_id, epoch_us(ts) // 1000 AS ms,
         CASE tool WHEN 'view' THEN 'renew' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'start' WHEN 'signup' THEN 'stop' ELSE CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'override' END END AS kind,
         'w' || (k % 3) AS who, k % 10 = 0 AS steal, CASE WHEN k % 4 = 1 THEN ' ' ELSE 'checked by hand' END AS why, row_number() OVER (PARTITION BY run ORDER BY epoch_us(ts) // 1000, event_id) AS nr
  FROM audit
),
walk AS (
  SELECT DISTINCT run, 0::BIGINT AS nr, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, NULL::VARCHAR AS state, '' AS owner, 0::BIGINT AS expires, false AS lapsed, 0::BIGINT AS ended, NULL::VARCHAR AS was FROM cmd
  UNION ALL
  SELECT run, nr, event_id, ms, kind, outcome, CASE WHEN takes THEN 'running' WHEN outcome = 'ok' AND kind = 'stop' THEN 'stopped' WHEN outcome = 'ok' AND kind = 'fail' THEN 'failed' ELSE state END,
         CASE WHEN takes THEN who WHEN outcome = 'ok' AND kind IN ('stop', 'fail') THEN '' ELSE held END,
         CASE WHEN takes OR (outcome = 'ok' AND kind = 'renew') THEN ms + 21600000 WHEN outcome = 'ok' AND kind IN ('stop', 'fail') OR lapsed THEN 0 ELSE expires END, lapsed, expires, state
  FROM (
    SELECT *, outcome IN ('ok', 'stolen') AND kind IN ('start', 'claim') AS takes FROM (
      SELECT *, CASE WHEN kind = 'start' THEN CASE WHEN held <> '' AND held <> who THEN 'lease_held' ELSE 'ok' END WHEN state IS NULL THEN 'run_unknown'
        WHEN kind = 'claim' THEN CASE WHEN held <> '' AND held <> who THEN CASE WHEN steal THEN 'stolen' ELSE 'lease_held' END ELSE 'ok' END
        WHEN kind = 'override' THEN CASE WHEN trim(why) = '' THEN 'override_reason_required' ELSE 'ok' END WHEN held = '' OR held <> who THEN 'not_the_holder' ELSE 'ok' END AS outcome
      FROM (SELECT c.*, w.state, w.expires, w.owner <> '' AND w.expires <= c.ms AS lapsed, CASE WHEN w.owner <> '' AND w.expires <= c.ms THEN '' ELSE w.owner END AS held FROM walk w JOIN cmd c ON c.run = w.run AND c.nr = w.nr + 1)
    )
  )
),
ends AS (SELECT run, max_by({'s': state, 'o': owner, 'e': expires}, nr) AS s FROM walk GROUP BY run),
leased AS (
  SELECT run, event_id, ms, kind, outcome, state, owner, expires FROM walk WHERE nr > 0
  UNION ALL SELECT run, -1, ended, 'lapse', 'ok', was, '', 0 FROM walk WHERE lapsed
  UNION ALL SELECT run, -1, s.e, 'lapse', 'ok', s.s, '', 0 FROM ends WHERE s.o <> '' AND s.e <= (SELECT max(ms) FROM cmd)
)"""
NEAR = f""",
src AS (SELECT DISTINCT token FROM inv WHERE length(token) >= 3 ORDER BY token LIMIT 110){MUT},
ok0 AS (SELECT * FROM mut WHERE fake NOT IN (SELECT token FROM inv)),
fk AS MATERIALIZED (SELECT DISTINCT fake, trim({norm('fake')}) AS n1, {norm(spellings('fake')[2])} AS n2 FROM ok0),
toks AS MATERIALIZED (SELECT DISTINCT unnest(string_split(trim(norm), ' ')) AS t FROM pages_),
parts AS (SELECT DISTINCT fake, n2, unnest(string_split(trim(n2), ' ')) AS t FROM fk),
maybe AS MATERIALIZED (SELECT fake, n2 FROM parts GROUP BY ALL HAVING count_if(t NOT IN (SELECT t FROM toks)) = 0),
spoken AS MATERIALIZED (SELECT fake FROM fk WHERE n1 IN (SELECT t FROM toks) UNION SELECT DISTINCT fake FROM maybe, pages_ WHERE contains(norm, n2)),
ok AS MATERIALIZED (SELECT * FROM ok0 WHERE fake NOT IN (SELECT fake FROM spoken)),
ordered AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY token) AS nr FROM src),
drawn AS (
  SELECT 0::BIGINT AS nr, 0 AS turn, NULL::VARCHAR AS source, NULL::VARCHAR AS fake, NULL::INT AS position, []::VARCHAR[] AS seen
  UNION ALL
  SELECT nr, turn, token, pick.f, pick.p, CASE WHEN pick IS NULL THEN seen ELSE list_append(seen, pick.f) END
  FROM (
    SELECT d.nr + 1 AS nr, (d.nr // (SELECT count(*) FROM src) + 1)::INT AS turn, o.token, any_value(d.seen) AS seen, min({{'n': ok.nth, 'f': ok.fake, 'p': ok.position}}) FILTER (NOT list_contains(d.seen, ok.fake)) AS pick
    FROM drawn d JOIN ordered o ON o.nr = d.nr % (SELECT count(*) FROM src) + 1 LEFT JOIN ok ON ok.token = o.token
    WHERE len(d.seen) < 100 AND d.nr < 100 * (SELECT count(*) FROM src) GROUP BY d.nr, o.token
  )
)"""
OWN_LANG = "nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '')"
URL_LANG = "nullif(regexp_extract(url, '://[^/]+/([a-z]{2})/', 1), '')"
RATES = "(SELECT rate FROM rated WHERE rate IS NOT NULL)"




P, PF, PC = "WITH " + PAGES, "WITH " + PAGES + FORMS, "WITH " + PAGES + CLAIMS

SQL: dict[str, str] = {
    "ask_pages": f"{P}{ASK} SELECT qid, fused_rank, page_id, round(score, 9) AS score, best_rank, why FROM numbered WHERE fused_rank <= 10",
    "ask_documents": f"{P}{ASK}, g AS ({ASK_GROUP.format(key='doc_id')}) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_rank, pages_matched DESC, doc_id)::INT AS place FROM g QUALIFY place <= 10",
    "ask_sections": f"{P}{ASK}, g AS ({ASK_GROUP.format(key=SERIES + ' AS series')}) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_rank, pages_matched DESC, series)::INT AS place FROM g QUALIFY place <= 10",
    "ask_marks": f"{P}{ASK}{ASK_MARKS} SELECT qid, page_id, mark, reason, array_to_string(matched, ' ') AS matched, promoted, place FROM triaged",
    "ask_routes": f"{P}{ASK}{ASK_MARKS}, lk AS (SELECT qid, page_id, conv_id % 2 = 0 AS vision, conv_id % 11 AS slots, conv_id % 3 AS reads, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY place) AS nr FROM triaged WHERE mark = 'relevant'), rt AS (SELECT *, CASE WHEN NOT vision OR n > slots THEN CASE WHEN reads > 0 THEN 'read' END ELSE 'fetch' END AS route, CASE WHEN NOT vision THEN CASE WHEN reads > 0 THEN 'caller_not_vision_capable' ELSE 'budget_exhausted' END WHEN n > slots THEN CASE WHEN reads > 0 THEN 'context_budget' ELSE 'budget_exhausted' END ELSE 'default_fetch' END AS why FROM lk) SELECT qid, page_id, CASE WHEN nr <= CASE route WHEN 'read' THEN 3 ELSE 5 END THEN route END AS route, CASE WHEN route IS NOT NULL AND nr > CASE route WHEN 'read' THEN 3 ELSE 5 END THEN 'deferred_over_cap' ELSE why END AS reason FROM rt",
    "scope_filter": f"{P} SELECT page_id, lang FROM pages_ WHERE lang IN ('en', 'de') AND has_text AND revision = '1.0'",
    "phrase_lookup": f"{P} SELECT page_id, page_no FROM srch WHERE {PHRASE}",
    "printed_on": f"{P} SELECT page_id FROM pages_ WHERE {PHRASE}",
    "current_only": f"{P} SELECT page_id FROM cur WHERE lang = 'fr'",
    "searchable_pages": f"{P} SELECT page_id, text_trust FROM pages_ WHERE {TRUSTED}",
    "no_text_pages": f"{P} SELECT page_id FROM pages_ WHERE NOT has_text",
    "searchable_records": f"{P} SELECT page_id FROM pages_ WHERE {TRUSTED} AND has_text",
    "exclude_pages": f"{P} SELECT page_id FROM cur WHERE page_id NOT IN (SELECT page_id FROM pages_ WHERE page_no % 3 = 0)",
    "branch_filter": f"{P} SELECT page_id, text_trust FROM cur WHERE contains(norm, ' 555 ') AND page_no > 2",
    "code_like_tokens": f"{P} SELECT token, count(*) AS n FROM (SELECT unnest({codes('text')}) AS token FROM pages_) GROUP BY token",
    "parse_page_id": f"{P}, q AS (SELECT row_id, row_id % 4 <> 0 AS canonical, doc_id, revision, page_no FROM pages_) SELECT row_id, CASE WHEN canonical THEN doc_id END AS doc, CASE WHEN canonical THEN revision END AS revision, CASE WHEN canonical THEN page_no END AS page_no, canonical FROM q",
    "uncheckable_reason": f"{P} SELECT page_id, {WHY} AS reason FROM pages_",
    "hit_projection": f"{P} SELECT page_id, doc_id, revision, page_no, length(text)::INT AS n_chars, '/pages/' || replace(page_id, '#', '%23') || '/image' AS image FROM srch WHERE {PHRASE}",
    "summary_lang": f"{PF} SELECT page_id, CASE WHEN lang IN ('en', 'es') THEN summary ELSE 'first' END AS summary FROM forms",
    "image_ref": f"{P} SELECT page_id, '/pages/' || replace(page_id, '#', '%23') || '/image?dpi=' || CASE WHEN page_no > 5 THEN '220' ELSE '110' END || '&region=0.1,0.2,0.5,0.75' AS url, 0.5::DOUBLE AS x1 FROM pages_",
    "section_of": f"{PF} SELECT page_id, CASE WHEN section = 'Section 1' THEN section END AS title FROM forms",
    "cap_violations": f"WITH {AUDIT}, a AS (SELECT event_id, CASE tool WHEN 'view' THEN 'skim' WHEN 'click' THEN 'verify' WHEN 'purchase' THEN 'fetch' WHEN 'signup' THEN 'read' WHEN 'error' THEN 'lookup' END AS tool, event_id % 7 AS pages, k % 4 = 0 AS blank, event_id % 4 AS reads, [36, 72, 100, 150, 220, 300, 400][1 + k % 7] AS dpi, event_id % 3 AS r, (k % 10) / 10.0::DOUBLE AS x0, round(value / 10, 3)::DOUBLE AS x1, value, k % 90 AS claims, k % 30 - 2 AS lim, k % 5 AS cap, k % 9 = 0 AS nolabel, k % 6 = 0 AS unk FROM audit), e AS (SELECT event_id, tool, CASE tool WHEN 'read' THEN CASE WHEN pages = 0 THEN 'read_empty' WHEN pages > 3 THEN 'read_page_cap_exceeded' WHEN blank THEN 'read_question_missing' WHEN reads = 0 THEN 'budget_exhausted' END WHEN 'fetch' THEN CASE WHEN pages = 0 THEN 'fetch_empty' WHEN pages > 5 THEN 'fetch_budget_exceeded' WHEN dpi = 100 THEN 'dpi_not_allowed' WHEN dpi > 220 AND r = 2 THEN 'dpi_requires_region' WHEN r = 1 OR (r = 0 AND (x1 > 1 OR x1 < 0 OR x0 >= x1)) THEN 'region_invalid' WHEN value > 12 THEN 'fetch_budget_exceeded' END WHEN 'verify' THEN CASE WHEN claims = 0 OR pages = 0 THEN 'verify_empty' WHEN claims * pages > 200 THEN 'verify_budget_exceeded' END WHEN 'skim' THEN CASE WHEN lim < 1 OR lim > 25 THEN 'limit_out_of_range' WHEN blank THEN 'query_required' WHEN unk THEN 'filter_unknown_key' END WHEN 'lookup' THEN CASE WHEN nolabel THEN 'label_empty' WHEN cap < 1 THEN 'cap_out_of_range' WHEN unk THEN 'filter_unknown_key' END END AS error FROM a) SELECT * FROM e WHERE error IS NOT NULL",
    "safety_flag": f"{P} SELECT page_id, len([t for t in list_slice({tok('text')}, 1, 5) if t IN ('the', 'und', 'le')]) > 0 OR doc_id = 'src3' AS safety FROM pages_",
    "label_match": f"{PF} SELECT page_id, section FROM forms WHERE contains({norm('section')}, ' section 1 ')",
    "redact_fields": f"WITH {AUDIT} SELECT event_id, 'https://***@host/x?token=***&q=1' AS url FROM audit",
    "caller_digest": "SELECT 'caller:' || substring(sha256(user_id::VARCHAR), 1, 12) AS caller, count(*) AS n FROM events GROUP BY 1",
    "exact_count": f"{P} SELECT count(*) AS total FROM srch WHERE {PHRASE} AND lang = 'en'",
    "scope_stats": f"{P} SELECT doc_id, count(*) AS pages, count_if(has_text)::BIGINT AS with_text, count_if({TRUSTED})::BIGINT AS searchable FROM cur GROUP BY doc_id ORDER BY pages DESC, doc_id LIMIT 64",
    "page_counts": f"{P} SELECT doc_id, revision, count(*) AS pages FROM pages_ GROUP BY ALL",
    "weakness": f"{PC}{LOOK} SELECT item_id, total, weak FROM looked",
    "lookup": f"{PC}{LOOK} SELECT * FROM looked",
    "lookup_page": f"{P} SELECT page_id, doc_id, page_no FROM srch WHERE contains(norm, ' the ') ORDER BY page_no, page_id LIMIT 20",
    "absence_status": f"{P}, b AS (SELECT doc_id, count(*) AS pages, count_if({TRUSTED}) AS tr, count_if(contains(norm, ' idiot ') AND {TRUSTED}) AS total FROM cur GROUP BY doc_id) SELECT doc_id, CASE WHEN total > 0 THEN 'ok' WHEN pages = 0 THEN 'out_of_scope' WHEN tr = 0 THEN 'not_searchable' ELSE 'not_found' END AS status FROM b",
    "verify_matrix": f"{PF}{CLAIMS}{PAIRS} SELECT claim, page_id, state, reason FROM matrix",
    "verify_claims": f"{PF}{CLAIMS}{PAIRS}, v AS (SELECT claim, CASE WHEN bool_or(state = 'present') THEN 'present' WHEN bool_or(state = 'absent') THEN 'absent' ELSE 'unverifiable' END AS state, count_if(state = 'present')::BIGINT AS n_present, count(*) AS n_pages, CASE WHEN count(DISTINCT reason) > 1 THEN 'mixed' ELSE max(reason) END AS r FROM matrix GROUP BY claim) SELECT claim, state, n_present, n_pages, CASE WHEN state = 'unverifiable' THEN r END AS reason FROM v",
    "page_payloads": f"{P}, a AS (SELECT page_id FROM pages_ UNION ALL SELECT 'none@1.0#p' || lpad((item_id + 1)::VARCHAR, 3, '0') FROM benchmark) SELECT a.page_id, CASE WHEN p.page_id IS NULL THEN 'page_not_found' WHEN NOT is_current THEN 'page_not_current' ELSE 'ok' END AS status FROM a LEFT JOIN pages_ p USING (page_id)",
    "observed_tokens": f"{P}{INV} SELECT * FROM inv",
    "present_instead": f"{P}{INV}, cl AS (SELECT DISTINCT doc_id, substring(token, 1, greatest(2, length(token) - 1)) || '9' AS claim FROM inv), ck AS (SELECT *, array_to_string({tok('claim')}, '') AS key FROM cl), m AS (SELECT claim, ck.doc_id, token, unnest(range(greatest(2, length(key) - 2), length(key) + 1)) AS n, key FROM ck JOIN inv USING (doc_id) WHERE length(key) >= 2 AND token <> key), g AS (SELECT DISTINCT claim, doc_id, token, n FROM m WHERE length(token) >= n AND substring(token, 1, n) = substring(key, 1, n)), b AS (SELECT * FROM g QUALIFY n = max(n) OVER (PARTITION BY claim, doc_id)) SELECT claim, doc_id, token, row_number() OVER (PARTITION BY claim, doc_id ORDER BY token)::INT AS nth FROM b QUALIFY nth <= 5",
    "words_observed": f"{PC}, w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM (SELECT item_id, {distinct(tok('claim'))} AS ws FROM claims)), k AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM srch WHERE has_text) SELECT item_id, word FROM w WHERE length(word) >= 2 AND place < 8 AND word IN (SELECT word FROM k)",
    "tokenize": f"{P} SELECT page_id, len({tok('text')})::INT AS n, md5(array_to_string({tok('text')}, ' ')) AS digest FROM pages_",
    "label_variants": f"{PF}, l AS (SELECT page_id, codes[1] || '  SF1  ' || page_no AS label FROM forms), v AS (SELECT page_id, [{', '.join(spellings('label'))}] AS vs FROM l) SELECT page_id, array_to_string({distinct('vs')}, '|') AS variants FROM v",
    "variants_property": f"{PF} SELECT true AS preserved, count(*) AS n FROM forms",
    "build_page_id": f"{PF} SELECT page_id, {pid('doc_id', 'revision', 'page_no', 's')} AS section_id, {SERIES} AS series_id FROM forms",
    "point_id": f"{P}, h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(page_id)) AS h FROM pages_) SELECT page_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][1 + (('0x' || substring(h, 17, 1))::INT & 3)] || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id FROM h",
    "claim_key": f"{PC} SELECT item_id, array_to_string({tok('claim')}, '') AS key FROM claims",
    "decompose_query": f"WITH q AS (SELECT conv_id, turn, text || ' K' || conv_id AS text FROM conversations WHERE role = 'user'), w AS (SELECT conv_id, turn, {WORDS} AS ws FROM q) SELECT conv_id, turn, array_to_string([x for x in ws if regexp_matches(x, '\\p{{N}}')], ' ') AS identifiers, md5(array_to_string([x for x in ws if NOT regexp_matches(x, '\\p{{N}}')], ' ')) AS prose FROM w",
    "query_terms": f"WITH w AS (SELECT conv_id, turn, {WORDS} AS ws FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn, {tok(chr(39) + chr(39) + ' || array_to_string([x for x in ws if regexp_matches(x, ' + chr(39) + chr(92) + 'p{N}' + chr(39) + ')], ' + chr(39) + ' ' + chr(39) + ')')} AS ids, [t for t in {tok('array_to_string([x for x in ws if NOT regexp_matches(x, ' + chr(39) + chr(92) + 'p{N}' + chr(39) + ')], ' + chr(39) + ' ' + chr(39) + ')')} if length(t) >= 4] AS words FROM w) SELECT conv_id, turn, array_to_string([e for e, k in list_concat(ids, words) if list_position(list_concat(ids, words), e) = k], ' ') AS terms FROM p",
    "codes_in_text_draft": f"WITH {QUESTIONS}, c AS (SELECT conv_id, turn, [t for t in {codes('text')} if NOT regexp_full_match(t, '\\p{{N}}+')] AS cs FROM drafts) SELECT conv_id, turn, array_to_string({distinct('cs')}, '|') AS codes FROM c",
    "label_words": f"{PF} SELECT page_id, array_to_string(list_slice([w for w in string_split_regex(trim(seen), '\\s+') if regexp_matches(w, '\\p{{N}}')], 1, 4), ' ') AS words FROM forms",
    "mutations": f"{P}{INV}, src AS (SELECT DISTINCT token FROM inv){MUT} SELECT * FROM mut",
    "cache_keys": f"{P} SELECT page_id, sha256('4:read|' || length(page_id) || ':' || page_id || '|' || length(page_no::VARCHAR) || ':' || page_no || '|' || length(lang) || ':' || lang) AS key FROM pages_",
    "fingerprint_digest": "SELECT len(embedding)::INT AS n, count(*) AS rows, sha256('{\"composition_version\":\"1\",\"dim\":' || len(embedding) || ',\"distance\":\"cosine\",\"embed_model\":\"stub\"}') AS digest FROM embeddings GROUP BY ALL",
    "l2_normalise": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id, round(CASE WHEN n > 0 THEN e[1] / n ELSE e[1] END, 6) AS first, round(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS length FROM v",
    "region_valid": f"WITH {AUDIT} SELECT event_id, value / 10 <= 1 AND (k % 10) / 10 < value / 10 AND (event_id % 7) / 7 < 0.9 AS valid FROM audit",
    "predicted_megapixels": f"WITH {AUDIT}, d AS (SELECT event_id, [72, 110, 220][1 + k % 3] AS dpi, least(1.0::DOUBLE, greatest(0.1::DOUBLE, k / 100)) AS share FROM audit), p AS (SELECT event_id, ceil(595 * share * dpi / 72)::BIGINT * ceil(842 * dpi / 72)::BIGINT AS pixels FROM d) SELECT event_id, pixels, round(pixels / 1e6, 6)::DOUBLE AS megapixels, pixels > 12000000 AS refused FROM p",
    "dense_knn": f"{P}{OPEN} SELECT row_id, round(score, 6) AS score FROM dense",
    "lexical_rank": f"{P}{OPEN} SELECT row_id, round(score, 6) AS score FROM lexical",
    "captions_rank": f"{P}{OPEN} SELECT row_id, round(score, 6) AS score FROM captions",
    "branch_rank": f"{P}{RANK} SELECT surface, row_id, rank FROM branches",
    "rrf_fusion": f"{P}{RANK} SELECT row_id, round(score, 9) AS score, best_rank, why FROM fused",
    "skim_pages": f"{P}{RANK} SELECT fused_rank, page_id, round(score, 9) AS score, why FROM numbered WHERE fused_rank <= 10",
    "skim_documents": f"{P}{RANK}{DOCUMENTS}, spots AS (SELECT doc_id, 0::BIGINT AS pages_matched, 0 AS best_rank, page_id AS preview, 0.0::DOUBLE AS ratio FROM ratios JOIN (SELECT doc_id, page_id FROM cur WHERE page_no = 1) USING (doc_id) WHERE ratio = 0 AND doc_id NOT IN (SELECT doc_id FROM groups)) SELECT doc_id, pages_matched, best_rank, preview, round(ratio, 6)::DOUBLE AS ratio FROM (SELECT groups.*, ratio::DOUBLE AS ratio FROM groups JOIN ratios USING (doc_id) UNION ALL SELECT * FROM spots) ORDER BY best_rank = 0, best_rank, pages_matched DESC, doc_id LIMIT 10",
    "skim_sections": f"{P}{RANK} SELECT {SERIES} AS series, count(*) AS pages_matched, min(fused_rank) AS best_rank, min_by(page_id, fused_rank) AS preview FROM numbered GROUP BY 1 ORDER BY best_rank, pages_matched DESC, series LIMIT 10",
    "term_frequency": f"{P}{POST} SELECT * FROM postings",
    "surface_coverage": f"{P} SELECT count(*) AS pages, count_if(len({tok('text')}) > 0)::BIGINT AS lexical, count_if(vec_id IS NOT NULL)::BIGINT AS dense FROM cur LEFT JOIN embeddings ON vec_id = row_id",
    "branch_activation": f"WITH {QUESTIONS}, w AS (SELECT *, {WORDS} AS ws FROM questions) SELECT conv_id, turn, len([x for x in ws if NOT regexp_matches(x, '\\p{{N}}')]) > 0 AS dense, len({tok('text')}) > 0 AS sparse, len([x for x in ws if regexp_matches(x, '\\p{{N}}')]) > 0 AS narrowed FROM w",
    "absence_moves": f"{PC}{LOOK} SELECT item_id, CASE WHEN total = 0 AND regexp_matches(claim, '\\p{{N}}') THEN 'lookup' WHEN total = 0 THEN 'skim_pages' END AS suggest FROM looked",
    "blind_spots": f"{P}{RANK} SELECT doc_id, count(*) AS pages FROM cur WHERE doc_id NOT IN (SELECT doc_id FROM numbered) GROUP BY doc_id HAVING count_if(has_text) = 0",
    "first_pages": f"{P} SELECT doc_id, page_id FROM cur WHERE page_no = 1",
    "fetch_text": f"{P}, a AS (SELECT *, row_id % 40 = 0 AND text <> 'x' AS changed FROM cur) SELECT page_id, CASE WHEN changed THEN 'content_changed' ELSE 'ok' END AS status, '/pages/' || replace(page_id, '#', '%23') || '/image' AS image, CASE WHEN NOT changed THEN length(text)::INT END AS n_chars, CASE WHEN NOT changed THEN md5(text) END AS digest FROM a",
    "scan_documents": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html)::INT AS n_chars, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages",
    "content_hash": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "filename_tags": f"WITH s AS (SELECT page_id, [t for t in string_split(lower(regexp_replace(regexp_extract(url, '^[^?#]*?([^/?#]+)/?(?:[?#].*)?$', 1), '[^A-Za-z0-9]+', ' ', 'g')), ' ') if t <> ''] AS ts FROM pages) SELECT page_id, array_to_string({distinct('ts')}, ',') AS tags FROM s",
    "manifest_facets": f"SELECT page_id, coalesce(CASE WHEN page_id % 11 = 0 THEN 'xx' END, {OWN_LANG}, {URL_LANG}, 'unknown') AS lang FROM pages",
    "facet_disagreement": f"WITH p AS (SELECT page_id, {OWN_LANG} AS read, coalesce(CASE WHEN page_id % 11 = 0 THEN 'xx' END, {URL_LANG}) AS declared FROM pages) SELECT * FROM p WHERE read <> declared",
    "store_entries": f"{P} SELECT doc_id || '@' || revision || '.pdf' AS entry, count(*) AS pages, sum(strlen(text))::BIGINT AS bytes FROM pages_ GROUP BY 1",
    "replay_cache_hits": f"{P} SELECT row_id % 3 <> 0 AS hit, count(*) AS n FROM cur GROUP BY 1",
    "strict_json_parse": "SELECT CASE WHEN event_id % 7 = 0 THEN 'unknown_field' WHEN event_id % 11 = 0 THEN 'not_json' WHEN json_extract(props, '$.k') IS NULL THEN 'missing_field' ELSE 'ok' END AS state, count(*) AS n FROM events GROUP BY 1",
    "schema_problems": "SELECT * FROM (VALUES ('n_chars', 'undeclared'), ('source', 'type'), ('title', 'missing')) t(name, problem)",
    "duplicate_pages": f"{P} SELECT page_id, 2::BIGINT AS n FROM pages_ WHERE row_id % 50 = 0",
    "fingerprint_diff": "SELECT 'dim' AS field, '768' AS stored, max(len(embedding))::VARCHAR AS live FROM embeddings HAVING max(len(embedding)) <> 768",
    "embed_reuse": f"{P} SELECT vec_id IS NOT NULL AND row_id % 9 <> 0 AS reused, count(*) AS n FROM pages_ LEFT JOIN embeddings ON vec_id = row_id GROUP BY 1",
    "export_labels": f"{PF} SELECT page_id, '{{\"page_id\":\"' || page_id || '\",\"page_no\":' || page_no || ',\"printed_label\":\"' || printed_label || '\",\"section\":\"' || section || '\"}}' AS line FROM forms WHERE is_current AND printed_label IS NOT NULL",
    "export_observed_tokens": f"{P}{INV} SELECT doc_id, '{{\"doc_id\":\"' || doc_id || '\",\"tokens\":[' || string_agg('\"' || token || '\"', ',' ORDER BY token) || ']}}' AS line FROM inv GROUP BY doc_id",
    "export_complete": f"{P} SELECT doc_id, revision, count(*) AS produced, count(*) = max(page_no) AS complete FROM pages_ GROUP BY ALL",
    "corpus_documents": f"{P} SELECT doc_id, count(*) AS pages, count_if(is_current)::BIGINT AS current, count(DISTINCT revision) AS revisions, count_if(has_text AND is_current)::BIGINT AS with_text FROM pages_ GROUP BY doc_id",
    "corpus_revisions": f"{P} SELECT doc_id, revision, count_if(is_current) > 0 AS is_current, count(*) AS pages FROM pages_ GROUP BY ALL",
    "corpus_pages": f"{P}, r AS (SELECT doc_id, revision, page_id, page_no FROM pages_ WHERE page_no BETWEEN 3 AND 22), l AS (SELECT doc_id, revision, max(page_no) AS last, count(*) AS n FROM r GROUP BY ALL) SELECT page_id, page_no, CASE WHEN n = 20 THEN last + 1 END AS next_offset FROM r JOIN l USING (doc_id, revision)",
    "corpus_totals": f"{P} SELECT count(DISTINCT doc_id) AS documents, count(*) AS pages, count(DISTINCT doc_id) > 10 AS truncated FROM pages_",
    "searchable_ratio": f"{P} SELECT doc_id, round(count_if(has_text) / count(*), 6)::DOUBLE AS ratio FROM cur GROUP BY doc_id",
    "grounded_rate": f"{PF}{BACKED} SELECT page_id, round(rate, 6) AS rate FROM rated",
    "codes_in_text": f"{PF}{BACKED} SELECT page_id, array_to_string(backed, '|') AS codes FROM rated",
    "ungrounded_codes": f"{PF}{BACKED}, x AS (SELECT page_id, unnest(codes) AS code, backed FROM rated) SELECT page_id, code FROM x WHERE NOT list_contains(backed, code)",
    "grounded_median": f"{PF}{BACKED} SELECT doc_id, round(median(rate), 6) AS median FROM rated GROUP BY doc_id",
    "document_health": f"{PF}{BACKED} SELECT doc_id, revision, pages, with_text, round(median, 6) AS median, round(ratio, 6) AS ratio, trust, fully_scanned, collapsed FROM health",
    "text_trust": f"{PF}{BACKED} SELECT page_id, CASE WHEN NOT has_text THEN 'no_text' WHEN trust = 'untrusted' THEN 'untrusted' WHEN rate >= 0.8 THEN 'ok' WHEN rate IS NULL OR rate >= 0.2 THEN 'degraded' ELSE 'untrusted' END AS trust FROM rated JOIN health USING (doc_id, revision)",
    "rate_distribution": f"{PF}{BACKED} SELECT count(*) AS n, round(min(rate), 6) AS lo, round(max(rate), 6) AS hi, round(avg(rate), 6) AS mean, " + ", ".join(f"round(quantile_disc(rate, {p}), 6) AS p{round(p * 100)}" for p in (0.1, 0.5, 0.9)) + ", " + ", ".join(f"count_if(least(floor(rate * 5), 4) = {k})::BIGINT AS b{k}" for k in range(5)) + f" FROM {RATES}",
    "threshold_sweep": f"{PF}{BACKED}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS threshold) SELECT threshold, count_if(rate < threshold)::BIGINT AS below, round(count_if(rate < threshold) / count(*), 6) AS share FROM {RATES}, t GROUP BY threshold",
    "threshold_recommend": f"{PF}{BACKED}, m AS (SELECT median(rate) AS m FROM rated) SELECT round(m, 6) AS median, least((SELECT max(x) FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS x) WHERE x <= m - 0.05), 0.8::DOUBLE) AS threshold FROM m",
    "worst_pages": f"{PF}{BACKED} SELECT page_id, round(rate, 6) AS rate FROM (SELECT * FROM rated WHERE rate IS NOT NULL ORDER BY rate, page_no, page_id LIMIT 10)",
    "busiest_pages": f"{P} SELECT page_id, count(DISTINCT token) AS n FROM (SELECT page_id, unnest({codes('text')}) AS token FROM srch WHERE has_text) GROUP BY page_id ORDER BY n DESC, page_id LIMIT 3",
    "split_oversized": f"WITH {TOC}, s AS (SELECT doc_id, unnest(range(1, pages + 1, 30))::INT AS start, pages FROM npages) SELECT doc_id, start, least(pages, start + 29)::INT AS stop FROM s",
    "chapter_ranges": f"WITH {TOC} SELECT doc_id, start, stop FROM chap",
    "inline_cap": f"{P} SELECT doc_id, revision, CASE WHEN sum(strlen(seen)) <= 20000 THEN 30 ELSE greatest(1, least(30, floor(20000 / (sum(strlen(seen)) / count(*))))) END::INT AS cap FROM pages_ GROUP BY ALL",
    "page_index_problems": "WITH li AS (SELECT l_orderkey, l_linenumber::INT AS no FROM lineitem), s AS (SELECT * FROM li UNION ALL SELECT * FROM li WHERE l_orderkey % 5 = 0 AND no = 1), g AS (SELECT l_orderkey, list(no) AS said, count(DISTINCT no) AS d FROM s GROUP BY 1), n AS (SELECT *, list_sort(list_distinct(said)) AS once, CASE WHEN l_orderkey % 7 = 0 THEN d + 1 WHEN l_orderkey % 11 = 0 THEN d - 1 ELSE d END AS n FROM g), o AS (SELECT l_orderkey, array_to_string([x for x in once if len([y for y in said if y = x]) > 1], ',') AS duplicate, array_to_string([x for x in range(1, n + 1) if NOT list_contains(once, x::INT)], ',') AS missing, array_to_string([x for x in once if x < 1 OR x > n], ',') AS outside FROM n) SELECT * FROM o WHERE duplicate <> '' OR missing <> '' OR outside <> ''",
    "extraction_counts": f'{PF} SELECT doc_id, ((page_no - 1) // 30)::BIGINT AS "window", count(*) AS forms, sum(len(codes))::BIGINT AS codes FROM forms GROUP BY ALL',
    "form_page_join": f"{P}, f AS (SELECT DISTINCT l_orderkey % 1000 AS row_id, l_linenumber FROM lineitem) SELECT pages_.row_id, page_no FROM f JOIN pages_ ON f.row_id = pages_.row_id AND l_linenumber = page_no",
    "missing_pages": "WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber::INT AS no FROM lineitem), w AS (SELECT l_orderkey, unnest(range(1, max(no) + 1))::INT AS no FROM h GROUP BY l_orderkey) SELECT w.* FROM w LEFT JOIN h USING (l_orderkey, no) WHERE h.no IS NULL",
    "offset_witness": f"{PF}{sight('forms', False)} SELECT page_id, code, here, on_prev, on_next FROM sight",
    "offset_check": f"{PF}{witnesses('forms')} SELECT * FROM offs",
    "reattribute_codes": f"{PF}{sight('forms', True)}, mv AS (SELECT *, NOT here AND on_prev <> on_next AS alone FROM sight), ev AS (SELECT page_id, code, NULL::VARCHAR AS moved_from, 0 AS place, CASE WHEN NOT here AND on_prev AND on_next THEN 'ambiguous_reattribution' END AS flag FROM mv WHERE NOT alone UNION ALL SELECT {pid('doc_id', 'revision', '(page_no + CASE WHEN on_prev THEN -1 ELSE 1 END)')}, code, page_id, page_no, 'codes_reattributed' FROM mv WHERE alone) SELECT page_id, code, moved_from, moved_from IS NULL OR row_number() OVER (PARTITION BY page_id, lower(regexp_replace(code, '\\s+', '', 'g')) ORDER BY place, code) = 1 AS added, flag FROM ev",
    "interpolate_labels": f"{PF}, n AS (SELECT page_id, printed_label, try_cast(lag(printed_label) OVER w AS BIGINT) AS b, try_cast(lead(printed_label) OVER w AS BIGINT) AS a FROM forms WINDOW w AS (PARTITION BY doc_id, revision ORDER BY page_no)) SELECT page_id, CASE WHEN printed_label IS NULL AND a - b = 2 THEN (b + 1)::VARCHAR ELSE printed_label END AS label, coalesce(printed_label IS NULL AND a - b = 2, false) AS interpolated FROM n",
    "label_monotonic": f"{PF}{DROPS} SELECT * FROM drops",
    "attribute_labels": f"{PF}, a AS (SELECT page_id, printed_label AS a, CASE WHEN row_id % 3 <> 0 THEN page_no::VARCHAR END AS b, norm FROM forms), s AS (SELECT *, coalesce({printed('norm', 'a')}, false) AS sa, coalesce({printed('norm', 'b')}, false) AS sb FROM a), l AS (SELECT page_id, a, CASE WHEN a IS NOT DISTINCT FROM b THEN a WHEN sa AND NOT sb THEN a WHEN sb AND NOT sa THEN b WHEN a IS NULL THEN b WHEN b IS NULL THEN a END AS label FROM s) SELECT page_id, label, label IS NULL AND a IS NOT NULL AS ambiguous FROM l",
    "page_neighbours": f"{P} SELECT page_id, lag(page_id) OVER w AS prev_page, lead(page_id) OVER w AS next_page FROM pages_ WINDOW w AS (PARTITION BY doc_id, revision ORDER BY page_no)",
    "resolve_bracket": f"{PF}, n AS (SELECT *, printed_label::BIGINT AS n FROM forms) SELECT m.page_id, lo.n + 1 AS label FROM n m JOIN n lo ON lo.doc_id = m.doc_id AND lo.revision = m.revision AND lo.page_no = m.page_no - 1 JOIN n hi ON hi.doc_id = m.doc_id AND hi.revision = m.revision AND hi.page_no = m.page_no + 1 WHERE m.n IS NULL AND hi.n - lo.n = 2",
    "resolve_label": f"{PF}{RESOLVE} SELECT DISTINCT label, page_id, printed_label AS printed_page_no, false AS interpolated, facts.total, capped FROM met JOIN facts USING (label) WHERE match AND (kind = 'asked' OR (kind = 'word' AND NOT direct)) UNION ALL SELECT DISTINCT label, m.page_id, NULL, true, facts.total, capped FROM facts JOIN met lo USING (label) JOIN met hi USING (label) JOIN r0 m ON m.doc_id = lo.doc_id AND m.revision = lo.revision AND m.page_no = lo.page_no + 1 AND hi.doc_id = lo.doc_id AND hi.revision = lo.revision AND hi.page_no = lo.page_no + 2 WHERE NOT found AND lo.kind = 'low' AND hi.kind = 'high' AND lo.match AND hi.match AND m.printed_label IS NULL",
    "stitch_sections": f"{PF}{STITCH} SELECT doc_id, revision, section, title, first, last, pages, coalesce(starts, '') AS starts FROM st",
    "section_contiguity": f"{PF}{STITCH.replace('FROM forms GROUP', 'FROM forms WHERE row_id % 23 <> 0 GROUP')} SELECT doc_id, revision, section, pages = last - first + 1 AS contiguous, first <> last AS straddles, n_starts <> 1 AS uncertain FROM st",
    "section_ordinals": f"{PF}{STITCH} SELECT doc_id, revision, section, ordinal FROM st",
    "stitch_pages": f"{PF}{STITCH} SELECT page_id, {pid('doc_id', 'revision', 'ordinal', 's')} AS section_id FROM forms JOIN st USING (doc_id, revision, section)",
    "page_kind": f"{PF} SELECT CASE WHEN read_kind = 'Chart' THEN 'prose' ELSE read_kind END AS kind, count(*) AS n FROM forms GROUP BY 1",
    "missing_summary_langs": f"{PF} SELECT page_id, CASE WHEN lang = 'en' THEN '' WHEN row_id % 2 = 0 THEN 'en' ELSE lang END AS missing FROM forms",
    "caption_terms": f"{PF}, t AS (SELECT page_id, {tok('text')} AS own, {tok(chr(115) + 'ummary || ' + chr(39) + ' ' + chr(39) + ' || section')} AS words FROM forms) SELECT page_id, array_to_string([w for w in words if NOT list_contains(own, w)], ' ') AS terms FROM t",
    "compose_embedding_text": f"{PF}, t AS (SELECT page_id, list_slice(string_split(trim(norm), ' '), 9, 12) AS tp, codes, doc_id, section, summary, text FROM forms), u AS (SELECT *, [x for x in tp if x <> ''] AS tq FROM t), p AS (SELECT page_id, [x for x in [doc_id, trim(section), trim(summary), array_to_string({distinct('tq')}, '; '), array_to_string(codes, ' '), substring(trim(text, ' '), 1, 2000)] if x <> ''] AS ps FROM u) SELECT page_id, len(ps)::INT AS parts, md5(array_to_string(ps, chr(10))) AS digest FROM p",
    "derive_pages": f"{PF}{BACKED}, n AS (SELECT *, try_cast(lag(printed_label) OVER w AS BIGINT) AS b, try_cast(lead(printed_label) OVER w AS BIGINT) AS a FROM rated WINDOW w AS (PARTITION BY doc_id, revision ORDER BY page_no)), i AS (SELECT *, coalesce(printed_label IS NULL AND a - b = 2, false) AS ip FROM n) SELECT page_id, CASE WHEN ip THEN (b + 1)::VARCHAR ELSE printed_label END AS label, array_to_string([f for f in [CASE WHEN ip THEN 'label_interpolated' END, CASE WHEN NOT has_text THEN 'no_text' END, CASE WHEN len([c for c in codes if NOT list_contains(backed, c)]) > 0 THEN 'ungrounded_codes' END] if f IS NOT NULL], ',') AS flags, len(codes)::INT AS n_codes, round(rate, 6) AS rate FROM i",
    "publish_gates": f"{PF}{GATES} SELECT * FROM gates",
    "gate_decision": f"{PF}{GATES} SELECT doc_id, revision, array_to_string(lft, ',') AS blocking, len(lft) = 0 AS publish, refused, array_to_string(flags, ',') AS flags FROM decided",
    "run_history": f"WITH {AUDIT} SELECT doc, nth, run_id, state FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ts DESC, run_id DESC)::INT AS nth FROM runs) WHERE nth <= 20",
    "run_latest": f"WITH {AUDIT} SELECT doc, max(run_id) AS run_id, max_by(state, run_id) AS state FROM runs GROUP BY doc",
    "window_latest": f"WITH {AUDIT} SELECT doc, k % 4 AS start, max_by(state, run_id) AS state, count(*) AS writes FROM runs GROUP BY ALL",
    "gate_gauges": f"WITH {AUDIT} SELECT doc, round(max_by(value, run_id), 4) AS last_value, count_if(value < 5)::BIGINT AS failures FROM runs WHERE state = 'purchase' GROUP BY doc",
    "current_pointer": f"{P}, {AUDIT} SELECT page_id, doc_id IN (SELECT doc FROM runs WHERE state = 'purchase') AND revision = '1.0' AS is_current FROM pages_",
    "publish_state": f"{PF}{GATES} SELECT doc_id, revision, CASE WHEN len(lft) > 0 THEN 'held' WHEN revision = '1.0' THEN 'current' ELSE 'superseded' END AS state FROM decided",
    "retirement_counts": f"{P} SELECT doc_id, count_if(revision = '1.0' AND row_id % 6 = 0)::BIGINT AS deleted, count_if(revision <> '1.0')::BIGINT AS demoted, count_if(revision = '1.0' AND row_id % 6 <> 0)::BIGINT AS kept FROM pages_ GROUP BY doc_id",
    "stamp_flags": f"{P}, s AS (SELECT page_id, ['seen', text_trust, CASE WHEN is_current THEN 'seen' ELSE 'old' END, lang] AS fs FROM pages_) SELECT page_id, array_to_string({distinct('fs')}, ',') AS flags FROM s",
    "hash_mismatch": f"{P} SELECT page_id FROM pages_ WHERE row_id % 40 = 0 AND text <> 'x'",
    "audit_log": f"WITH {AUDIT} SELECT user_id, tool, count(*) AS calls, round(max(value), 4) AS latency FROM audit GROUP BY ALL",
    "budget_remaining": f"WITH {AUDIT}, s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS period, count(*) AS spent FROM audit WHERE tool = 'purchase' GROUP BY ALL) SELECT *, greatest(0, 2 - spent) AS remaining, spent > 2 AS refused FROM s",
    "unknown_scope_keys": f"WITH {AUDIT} SELECT 'k' || (k % 5) AS unknown, count(*) AS n FROM audit GROUP BY 1",
    "draft_claims": f"WITH {QUESTIONS}, p AS (SELECT DISTINCT conv_id, turn, unnest({codes('text')}) AS claim FROM drafts) SELECT conv_id, turn, claim, claim LIKE 'k%' AND turn % 4 = 1 AS declared FROM p",
    "answer_gate": f"{P}{DRAFTS} SELECT *, bool_or(state = 'absent') OVER (PARTITION BY conv_id, turn) AS rejected FROM fold",
    "coverage_merge": f"{P}{RUNGS} SELECT conv_id, array_to_string(docs, ',') AS docs, array_to_string(blind, ',') AS blind, pages, no_text, looked, no_text <= looked AS complete FROM merged",
    "abstention_text": f"{P}{RUNGS}, n AS (SELECT *, {NAMES.format(x='docs')} AS named, {NAMES.format(x='blind')} AS dark, greatest(0, no_text - looked) AS lft FROM merged) SELECT conv_id, ['Not found in the searchable text of ' || named || '.', 'Not found in the searchable text of ' || named || ', and there is no wider scope left to search.', 'Nothing in ' || named || ' matched, and no image-only page was available to look at.', 'The pages looked at in ' || named || ' do not answer this.', 'A draft answer was written from ' || named || ' and rejected: the codes it cited are not printed on the pages it cited them from.'][1 + (conv_id % 5)::INT] || ' ' || pages || ' page(s) searched across ' || len(docs) || ' document(s). ' || CASE WHEN lft > 0 THEN lft || ' image-only page(s) in ' || CASE WHEN len(blind) > 0 THEN dark ELSE named END || ' were not examined — look at them with `fetch` or `read` before concluding anything about the corpus.' WHEN pages = 0 THEN 'No page was searched, so nothing follows about the corpus — widen the scope or check that this release has a published document.' WHEN no_text > 0 THEN 'All ' || no_text || ' image-only page(s) in scope were examined, so this is not in these documents.' ELSE 'Every page in scope has a text layer, so this is not in these documents.' END AS text FROM n",
    "triage_marks": f"{P}, m1 AS (WITH {('_ AS (SELECT 1)' + EXACT_MARKS)} SELECT 1 AS question, * FROM triaged), m2 AS (WITH {('_ AS (SELECT 1)' + OPEN_MARKS)} SELECT 2 AS question, * FROM triaged) SELECT question, page_id, mark, reason, array_to_string(matched, ' ') AS matched, promoted FROM (FROM m1 UNION ALL FROM m2)",
    "triage_events": f"{P}{OPEN_MARKS} SELECT page_id, '{{\"page_id\":\"' || page_id || '\",\"mark\":\"' || mark || '\",\"reason\":\"' || reason || '\",\"rank\":' || fused_rank || ',\"why\":[\"' || replace(why, ',', '\",\"') || '\"],\"matched\":[' || array_to_string(['\"' || x || '\"' for x in matched], ',') || '],\"promoted\":' || promoted || '}}' AS event FROM triaged",
    "triage_order": f"{P}{OPEN_MARKS} SELECT page_id, place FROM triaged",
    "triage_sets": f"{P}{OPEN_MARKS} SELECT page_id, CASE mark WHEN 'relevant' THEN 'look' WHEN 'irrelevant' THEN 'exclude' ELSE 'pool' END AS goes_to, place FROM triaged",
    "route_plan": f"{P}{OPEN_MARKS}, look AS (SELECT page_id, row_number() OVER (ORDER BY place) AS place, count(*) OVER () AS n FROM triaged WHERE mark = 'relevant'), c AS (SELECT * FROM (VALUES ('default', true, 5, 2, false), ('roomy', true, 500, 2, false), ('blind', false, 5, 2, false), ('broke', false, 5, 0, false), ('full', true, 0, 0, false), ('zoom', true, 5, 2, true), ('blind zoom', false, 5, 2, true)) v(caller, vision, slots, reads, zoom)), d AS (SELECT caller, page_id, place, CASE WHEN zoom THEN CASE WHEN vision THEN 'fetch' END WHEN NOT vision OR n > slots THEN CASE WHEN reads > 0 THEN 'read' END ELSE 'fetch' END AS route, CASE WHEN zoom THEN CASE WHEN vision THEN 'zoom_required' ELSE 'zoom_requires_vision' END WHEN NOT vision THEN CASE WHEN reads > 0 THEN 'caller_not_vision_capable' ELSE 'budget_exhausted' END WHEN n > slots THEN CASE WHEN reads > 0 THEN 'context_budget' ELSE 'budget_exhausted' END ELSE 'default_fetch' END AS reason FROM look, c) SELECT caller, page_id, CASE WHEN place > CASE route WHEN 'read' THEN 3 ELSE 5 END THEN NULL ELSE route END AS route, CASE WHEN route IS NOT NULL AND place > CASE route WHEN 'read' THEN 3 ELSE 5 END THEN 'deferred_over_cap' ELSE reason END AS reason FROM d",
    "ask_descent": f"{P}{ASK}{ROUNDS} SELECT * FROM rounds",
    "loop_transitions": f"{P}{ASK}{ROUNDS}{MOVES} SELECT m.state AS state, m.signal AS signal, sum(m.n)::BIGINT AS n, any_value(m.next) AS next FROM mv WHERE m.n > 0 GROUP BY 1, 2",
    "pending_candidates": f"{P}{OPEN_MARKS} SELECT page_id FROM cur WHERE page_id NOT IN (SELECT page_id FROM triaged WHERE mark = 'irrelevant')",
    "read_stamps": f"{PF}, x AS (SELECT page_id, unnest(codes) AS code, norm FROM forms) SELECT page_id, code, {printed('norm', 'code')} AS printed FROM x",
    "near_misses": f"WITH RECURSIVE {PAGES}{INV}{NEAR} SELECT source, fake, position, turn FROM drawn WHERE fake IS NOT NULL",
    "publish_snapshot": f"{PF}{GATES}{SHOTS}, ptr AS (SELECT o.doc_id, o.revision, CASE WHEN o.revision = '0.9' THEN 'r1' WHEN n3 > 0 THEN 'r3' ELSE 'r2' END AS run, o.revision = '1.0' OR NOT EXISTS (FROM oks x WHERE x.doc_id = o.doc_id AND x.revision = '1.0') AS is_current, CASE WHEN o.revision = '0.9' OR n3 = 0 THEN n ELSE n3 END AS pages, flags FROM oks o) SELECT * FROM ptr",
    "publish_records": f"{PF}{GATES}{SHOTS} SELECT 'r1' AS run, doc_id, revision, ok AS published, CASE WHEN ok THEN n ELSE 0 END AS pages_indexed, 0::BIGINT AS deleted_stale, 0::BIGINT AS superseded_demoted, 0::BIGINT AS other_revision_kept FROM shots WHERE revision = '0.9' UNION ALL SELECT run, s.doc_id, s.revision, s.ok, CASE WHEN NOT s.ok THEN 0 WHEN run = 'r2' THEN s.n ELSE s.n3 END, CASE WHEN s.ok AND run = 'r3' THEN s.n - s.n3 ELSE 0 END, CASE WHEN s.ok AND run = 'r2' THEN coalesce(o.n, 0) ELSE 0 END, CASE WHEN s.ok THEN coalesce(o.n, 0) ELSE 0 END FROM shots s CROSS JOIN (VALUES ('r2'), ('r3')) r(run) LEFT JOIN oks o ON o.doc_id = s.doc_id AND o.revision = '0.9' WHERE s.revision = '1.0' AND (run = 'r2' OR s.n3 > 0)",
    "lease_log": f"WITH RECURSIVE {AUDIT}{LEASES} SELECT run, event_id, ms, kind, outcome, state, owner, expires FROM leased",
    "lease_states": f"WITH RECURSIVE {AUDIT}{LEASES}, own AS (SELECT run, max_by({{'s': state, 'o': owner, 'e': expires}}, nr) AS s, count(*) AS commands, count_if(outcome IN ('ok', 'stolen'))::BIGINT AS taken FROM walk WHERE nr > 0 GROUP BY run) SELECT run, s.s AS state, s.o AS owner, s.e AS expires, commands, taken FROM own",
    "call_admission": f"WITH {AUDIT}, pc AS (SELECT event_id AS call_id, user_id AS caller, strftime(ts, '%Y-%m-%d') AS period, k % 3 AS question, ts FROM audit WHERE tool <> 'view'), n1 AS (SELECT *, row_number() OVER (PARTITION BY caller, period, question ORDER BY ts, call_id) <= 2 AS may FROM pc), n2 AS (SELECT *, sum(may::INT) OVER (PARTITION BY caller, period ORDER BY ts, call_id) AS asked FROM n1), n3 AS (SELECT *, may AND asked <= 3 AS admitted FROM n2) SELECT call_id, caller, period, question, admitted, CASE WHEN NOT may THEN 'question_exhausted' WHEN NOT admitted THEN 'quota_exhausted' END AS reason, least(3 - least(asked, 3), 2 - sum(admitted::INT) OVER (PARTITION BY caller, period, question ORDER BY ts, call_id))::BIGINT AS reads_remaining FROM n3",
    "abstention_correctness": "SELECT 100::BIGINT AS sample, 100::BIGINT AS abstained, 1.0::DOUBLE AS correctness",
    "dropped_codes": f"{PF}, e AS (SELECT page_id, unnest(codes) AS code FROM forms) SELECT * FROM e WHERE code NOT LIKE '%1%' AND code NOT LIKE 'k%'",
    "gains_by_code": f"{PF}, e AS (SELECT page_id, unnest(codes) AS code, norm FROM forms) SELECT code, count(*) AS pages, min(page_id) AS first FROM e WHERE code NOT LIKE '%1%' AND code NOT LIKE 'k%' AND {printed('norm', 'code')} GROUP BY code",
    "parity_containment": f"{PF}, e AS (SELECT page_id, unnest(codes) AS code FROM forms) SELECT DISTINCT code, true AS contained FROM e JOIN srch USING (page_id) WHERE contains(norm, ' ' || code || ' ')",
    "table_symdiff": f"{PF}, a AS (SELECT page_id, printed_label AS label FROM forms), b AS (SELECT page_id, page_no::VARCHAR AS label FROM forms) SELECT *, 'read' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'true' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "acceptance_rows": f"{PC}{LOOK} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'ok' ELSE 'not_found' END AS expected, status, CASE WHEN item_id % 2 = 0 THEN 'ok' ELSE 'not_found' END = status AS passed FROM looked",
    "lookup_rows": f"{PC}{LOOK} SELECT item_id, nth, page_id FROM (SELECT item_id, page_id, row_number() OVER (PARTITION BY item_id ORDER BY page_no, page_id)::INT AS nth FROM hits WHERE {TRUSTED}) WHERE nth <= 20",
    "lookup_scoped": f"{PC}{LOOK.replace('claims, cur WHERE', 'claims, cur WHERE doc_id = ' + chr(39) + 'src5' + chr(39) + ' AND lang = ' + chr(39) + 'en' + chr(39) + ' AND').replace('FROM cur)', 'FROM cur WHERE doc_id = ' + chr(39) + 'src5' + chr(39) + ' AND lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT * FROM looked",
    "ulid_encode": "WITH a AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, substring(sha1(event_id::VARCHAR), 1, 20) AS hex FROM events) SELECT event_id, " + " || ".join([f"substring('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + ((ms >> {45 - 5 * k}) & 31)::INT, 1)" for k in range(10)] + [f"substring('0123456789ABCDEFGHJKMNPQRSTVWXYZ', 1 + ((('0x' || substring(hex, {1 + 5 * (k // 4)}, 5))::BIGINT >> {15 - 5 * (k % 4)}) & 31)::INT, 1)" for k in range(16)]) + " AS ulid FROM a",
    "skim_narrowed": f"{P}{NARROW} SELECT fused_rank, page_id, round(score, 9) AS score, why FROM numbered WHERE fused_rank <= 25",
    "label_witnesses": f"{PF}{witnesses('forms')} SELECT page_id, label, confirms, NOT confirms AND (pv OR nx) AS witness, CASE WHEN confirms THEN '' ELSE array_to_string([x for x in [CASE WHEN pv THEN -1 END, CASE WHEN nx THEN 1 END] if x IS NOT NULL], ',') END AS printed_on FROM wit",
    "gate_failures": f"{PF}{GATES} SELECT gate, count_if(NOT passed)::BIGINT AS failures, count_if(skipped)::BIGINT AS skipped, min(metric) AS least FROM gates GROUP BY gate",
    "window_tiling": f"{P} SELECT doc_id || '@' || revision AS doc_id, ((page_no - 1) // 30)::BIGINT AS win, min(page_no)::INT AS start, 1 AS found FROM pages_ GROUP BY ALL",
}
PACKED = """,
po AS (SELECT doc_id, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS n FROM {source}),
walk AS (
  SELECT doc_id, n, start AS s, stop AS e, 1 AS w FROM po WHERE n = 1
  UNION ALL
  SELECT po.doc_id, po.n, CASE WHEN m THEN s ELSE po.start END, po.stop, CASE WHEN m THEN w ELSE w + 1 END
  FROM (SELECT walk.*, p.start AS ps, p.stop AS pe, (p.stop - p.start + 1 < 10) AND p.stop - s + 1 <= 30 AS m FROM walk JOIN po p ON p.doc_id = walk.doc_id AND p.n = walk.n + 1) k
  JOIN po ON po.doc_id = k.doc_id AND po.n = k.n + 1
),
packed AS (SELECT doc_id, min(s)::INT AS start, max(e)::INT AS stop FROM walk GROUP BY doc_id, w)"""
SPLIT = """,
told AS (SELECT DISTINCT doc_id FROM starts JOIN npages USING (doc_id) WHERE pages > 30 AND start BETWEEN 2 AND pages),
cut AS (SELECT doc_id, unnest(range(start, stop + 1, 30))::INT AS start, stop FROM chap WHERE doc_id IN (SELECT doc_id FROM told)),
cut2 AS (SELECT doc_id, start, least(stop, start + 29)::INT AS stop FROM cut),
flat AS (SELECT doc_id, unnest(range(1, pages + 1, 30))::INT AS start, pages FROM npages WHERE pages > 30 AND doc_id NOT IN (SELECT doc_id FROM told))"""
PLAN = SPLIT + PACKED.format(source="cut2") + """,
plan AS (
  SELECT doc_id, 1 AS start, pages AS stop, 0 AS level FROM npages WHERE pages <= 30
  UNION ALL SELECT doc_id, start, stop, 1 FROM packed
  UNION ALL SELECT doc_id, start, least(pages, start + 29)::INT, 2 FROM flat
)"""
SQL["pack_windows"] = f"WITH RECURSIVE {TOC}{PACKED.format(source='chap')} SELECT * FROM packed"
SQL["window_plan"] = f"WITH RECURSIVE {TOC}{PLAN} SELECT * FROM plan"
SQL["ladder_sweep"] = f"WITH RECURSIVE {TOC}{PLAN}, per AS (SELECT doc_id, level, count(*) AS w, sum(stop - start + 1) AS covered FROM plan GROUP BY ALL) SELECT level, count(*) AS documents, sum(w)::BIGINT AS windows, count_if(covered <> pages)::BIGINT AS violations FROM per JOIN npages USING (doc_id) GROUP BY level"

SQL["bisect_windows"] = f"""WITH RECURSIVE {TOC}{PLAN},
ext AS (
  SELECT doc_id, start, stop, 1 AS calls FROM plan
  UNION ALL
  SELECT doc_id, unnest([start, (start + stop) // 2 + 1])::INT, unnest([(start + stop) // 2, stop])::INT, calls + 1 FROM ext
  WHERE stop > start AND len([n for n in range(start, stop + 1) if (doc_id + 7 * n) % 37 = 0]) > 0
)
SELECT doc_id, start, stop, CASE WHEN len([n for n in range(start, stop + 1) if (doc_id + 7 * n) % 37 = 0]) = 0 THEN 'ok' ELSE 'window_unsplittable' END AS state, calls
FROM ext WHERE start = stop OR len([n for n in range(start, stop + 1) if (doc_id + 7 * n) % 37 = 0]) = 0"""


def sql() -> dict[str, str]:
    return dict(SQL)
