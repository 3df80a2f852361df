"""DuckDB SQL for the queries of this package, written from the definitions
rather than from the Spark plans."""

from __future__ import annotations

from docloom.plans.profile import POLICY_ISSUES, POLICY_SELECTION, POLICY_TAGS, TAG_FIELDS, When
from docloom.plans.queries import CONFIG_TEXT, POLICY_DOCUMENT, rule_phrases

NL = "chr(10)"


def norm(x: str) -> str:
    return f"lower(strip_accents(replace(replace(coalesce({x}, ''), 'đ', 'd'), 'Đ', 'D')))"


def toks(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[a-z0-9]+')"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({norm(x)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def has(x: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def words(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


# Documents as chunks, passages as questions.
CHUNKS = rf"""
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id, regexp_extract(source, '[0-9]+') AS section_number, split_part(text, {NL}, 1) AS section_title, source AS chapter_title, text, lang, source
  FROM documents)"""

TERMS = f"""
terms AS (
  SELECT chunk_id, token, sum(w) AS w FROM (
    SELECT chunk_id, unnest({toks("section_title")}) AS token, 2.0::DOUBLE AS w FROM chunks UNION ALL
    SELECT chunk_id, unnest({toks("chapter_title")}), 0.5::DOUBLE FROM chunks UNION ALL
    SELECT chunk_id, unnest({toks("text")}), 1.0::DOUBLE FROM chunks UNION ALL
    SELECT chunk_id, unnest({toks("lang")}), 1.0::DOUBLE FROM chunks UNION ALL
    SELECT chunk_id, unnest({toks("source")}), 1.0::DOUBLE FROM chunks)
  GROUP BY ALL),
flat AS (SELECT chunk_id, doc_id, lang, array_to_string({toks("section_title")}, ' ') AS title, array_to_string({toks("text")}, ' ') AS body FROM chunks)"""


def lexical(queries: str, extra: str = "", k: int = 5) -> str:
    """queries: a SELECT of question_id, query and wanted (a language or null);
    extra: SQL that is added to the score of a (q, f) pair."""
    return f"""
q AS ({queries}),
qt AS (SELECT question_id, token, count(*) AS n FROM (SELECT question_id, unnest({toks("query")}) AS token FROM q) GROUP BY ALL),
hits AS (SELECT qt.question_id, t.chunk_id, sum(qt.n * t.w) AS hits FROM qt JOIN terms t USING (token) GROUP BY ALL),
phrase AS (SELECT question_id, wanted, array_to_string({toks("query")}, ' ') AS p FROM q),
scores AS (
  SELECT question_id, chunk_id, doc_id, score FROM (
    SELECT p.question_id, f.chunk_id, f.doc_id, coalesce(h.hits, 0) + CASE WHEN p.p <> '' AND contains(f.title, p.p) THEN 5 ELSE 0 END + CASE WHEN p.p <> '' AND contains(f.body, p.p) THEN 3 ELSE 0 END {extra} AS score
    FROM phrase p CROSS JOIN flat f LEFT JOIN hits h ON h.question_id = p.question_id AND h.chunk_id = f.chunk_id
    WHERE p.p <> '' AND (p.wanted IS NULL OR p.wanted = f.lang))
  WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scores),
best AS (SELECT question_id, chunk_id, score, rank FROM ranked WHERE rank <= {k})"""


PLAIN = "SELECT item_id AS question_id, text AS query, CAST(NULL AS VARCHAR) AS wanted FROM benchmark"
BY_LANG = "SELECT item_id AS question_id, text AS query, (['en', 'de', 'fr', 'es'])[item_id % 4 + 1] AS wanted FROM benchmark"
TOP = "SELECT question_id, chunk_id, round(score, 4) AS score, rank FROM best"


def bm25(queries: str, k: int = 5) -> str:
    return f"""
q AS ({queries}),
qt AS (SELECT question_id, wanted, token, count(*) AS qn FROM (SELECT question_id, wanted, unnest({toks("query")}) AS token FROM q) GROUP BY ALL),
bags AS (SELECT chunk_id, doc_id, lang, {toks(f"section_title || {NL} || chapter_title || {NL} || text")} AS ws FROM chunks),
tf AS (SELECT chunk_id, doc_id, lang, token, len_ AS dl, count(*) AS tf FROM (SELECT chunk_id, doc_id, lang, len(ws) AS len_, unnest(ws) AS token FROM bags) GROUP BY ALL),
scopes AS (SELECT DISTINCT wanted FROM q),
stats AS (SELECT s.wanted, count(*) AS n, avg(len(b.ws)) AS avgdl FROM scopes s JOIN bags b ON s.wanted IS NULL OR s.wanted = b.lang GROUP BY ALL),
dfs AS (SELECT s.wanted, t.token, count(*) AS df FROM scopes s JOIN tf t ON s.wanted IS NULL OR s.wanted = t.lang GROUP BY ALL),
scores AS (
  SELECT qt.question_id, t.chunk_id, t.doc_id,
    round(sum(qt.qn * ln((s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE) + 1) * (t.tf * 2.5::DOUBLE) / (t.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * t.dl / s.avgdl))), 9) AS score
  FROM qt JOIN stats s ON s.wanted IS NOT DISTINCT FROM qt.wanted JOIN dfs d ON d.wanted IS NOT DISTINCT FROM qt.wanted AND d.token = qt.token
    JOIN tf t ON t.token = qt.token AND (qt.wanted IS NULL OR qt.wanted = t.lang)
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0),
best AS (SELECT question_id, chunk_id, score, rank FROM ranked WHERE rank <= {k})"""


# Line states of running text.
LINES = rf"""
ln AS (
  SELECT doc_id, unnest(string_split(text, {NL})) AS line, unnest(generate_series(1, len(string_split(text, {NL})))) AS pos FROM documents),
l2 AS (SELECT *, {strip("line")} AS s FROM ln),
l3 AS (
  SELECT *, CASE WHEN regexp_full_match(s, '.{{1,12}}') THEN 'chapter_header' WHEN regexp_full_match(s, 'Annex .*') THEN 'appendix' WHEN regexp_full_match(s, '.{{13,40}}') THEN 'dieu' END AS main FROM l2),
l4 AS (
  SELECT *, coalesce(last_value(CASE WHEN main IS NOT NULL THEN main = 'appendix' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AND regexp_full_match(s, 'Table .*') AND (main IS NULL OR main = 'dieu') AS is_sub FROM l3),
l5 AS (SELECT *, CASE WHEN is_sub THEN 'appendix_sub' ELSE main END AS kind FROM l4),
l6 AS (
  SELECT doc_id, pos, kind, CASE WHEN kind IS NOT NULL THEN s ELSE line END AS kept, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seg_id,
    coalesce(last_value(CASE WHEN kind = 'chapter_header' THEN s END IGNORE NULLS) OVER w, '') AS chapter_title, CASE WHEN kind IS NOT NULL THEN s END AS heading
  FROM l5 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
seg AS (
  SELECT doc_id, CAST(seg_id AS BIGINT) AS seg_id, coalesce(max(kind), 'preamble') AS chunk_type, max(chapter_title) AS chapter_title, coalesce(max(heading), '') AS heading,
    {strip(f"string_agg(kept, {NL} ORDER BY pos)")} AS text FROM l6 GROUP BY doc_id, seg_id),
segs AS (
  SELECT *, CASE WHEN chunk_type = 'dieu' THEN regexp_replace({strip("'Section . ' || heading")}, '\.\s*$', '') WHEN chunk_type = 'appendix_sub' THEN heading ELSE {strip("regexp_replace(heading, '^#+', '')")} END AS section_title
  FROM seg WHERE text <> '')"""

MERGED = f"""
st AS (SELECT *, length(text) >= 80 OR row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) = 1 AS starts FROM segs),
no AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY seg_id) AS chunk_no FROM st),
merged AS (SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, arg_min(chunk_type, seg_id) AS chunk_type, string_agg(text, {NL} || {NL} ORDER BY seg_id) AS text FROM no GROUP BY doc_id, chunk_no)"""

# Rule tags of documents, as arrays in rule order.
FOLDED = f"f AS (SELECT 'd' || doc_id AS chunk_id, source AS doc_id, doc_id AS no, ' ' || {norm('text')} AS t FROM documents)"


_EN, _DE, _RO, _LE = has("t", "the ", "and "), has("t", " und ", " die "), has("t", " les ", " que "), has("t", "licensed", "copyright")


def _list(*rules: tuple[str, str]) -> str:
    """The tags whose condition holds; here no tag comes twice in one array."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{tag}' END" for tag, c in rules) + "], lambda x: x IS NOT NULL)"


_SECRET = f"({_EN} AND contains(t, 'token =') OR {_DE} AND {has('t', 'token =', 'password')})"
ANNOTATED = f"""
{FOLDED},
a AS (
  SELECT chunk_id, doc_id, no, {_list(("english", _EN), ("german", _DE), ("romance", _RO), ("legal", _LE))} AS policy_area,
    {_list(("read_english", _EN), ("has_token", f"({_EN} AND contains(t, 'token ='))"), ("read_german", _DE), ("read_romance", _RO))} AS action_tags,
    {_list(("check_licence", _LE))} AS procedure_tags, {_list(("licence", f"({_RO} AND contains(t, 'licen') OR {_LE})"))} AS evidence_groups, {_list(("secret", _SECRET))} AS risk_tags,
    {_list(("long_word", f"({_EN} AND {has('t', 'ation', 'tion')} AND contains(t, 'ing'))"))} AS requirement_tags
  FROM f),
tg AS (
  SELECT chunk_id, 'policy_area' AS field, 'policy_area' AS prefix, 'PolicyArea' AS kind, 'CHUNK_HAS_POLICY_AREA' AS edge, unnest(policy_area) AS tag FROM a UNION ALL
  SELECT chunk_id, 'action_tags', 'action_tag', 'ActionTag', 'CHUNK_HAS_ACTION_TAG', unnest(action_tags) FROM a UNION ALL
  SELECT chunk_id, 'procedure_tags', 'procedure_tag', 'ProcedureTag', 'CHUNK_HAS_PROCEDURE_TAG', unnest(procedure_tags) FROM a UNION ALL
  SELECT chunk_id, 'evidence_groups', 'evidence_group', 'EvidenceGroup', 'CHUNK_HAS_EVIDENCE_GROUP', unnest(evidence_groups) FROM a UNION ALL
  SELECT chunk_id, 'risk_tags', 'risk_tag', 'RiskTag', 'CHUNK_HAS_RISK_TAG', unnest(risk_tags) FROM a UNION ALL
  SELECT chunk_id, 'requirement_tags', 'requirement_tag', 'RequirementTag', 'CHUNK_HAS_REQUIREMENT_TAG', unnest(requirement_tags) FROM a)"""

# Citations in texts made of lineitem.
CITED = """WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS chunk_id, CASE WHEN l_quantity > 25 THEN CAST(l_linenumber AS VARCHAR) END AS own, * FROM lineitem), cited AS (
            SELECT chunk_id, l_orderkey AS doc, 1 AS level, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS diem, CAST(l_linenumber AS VARCHAR) AS khoan, CAST(l_suppkey % 50 AS VARCHAR) AS dieu FROM l UNION ALL
            SELECT chunk_id, l_orderkey, 1, 1, NULL, '3', own FROM l WHERE own IS NOT NULL UNION ALL SELECT chunk_id, l_orderkey, 0, 2, 'b', '2', CAST(l_partkey % 7 AS VARCHAR) FROM l UNION ALL
            SELECT chunk_id, l_orderkey, 2, 3, NULL, NULL, CAST(l_orderkey % 5 AS VARCHAR) FROM l)"""

# Faults of configurations, key by key.
CONFIGS = f"""WITH raw AS (SELECT o_orderkey AS path, {CONFIG_TEXT} AS t FROM orders), c AS (SELECT path, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM raw),
top AS (SELECT path, j, unnest(['domain_id', 'domain_name', 'version', 'language', 'institution', 'fallback_scope_disclaimer', 'current_semester_missing_notice_message', 'certificate_keywords',
  'current_semester_keywords', 'document_types', 'issue_definitions']) AS k FROM c WHERE j IS NOT NULL),
defs AS (SELECT path, unnest(json_extract(j, '$.issue_definitions[*]')) AS d, unnest(generate_series(0, CAST(json_array_length(j, '$.issue_definitions') AS BIGINT) - 1)) AS i FROM c WHERE json_type(j, '$.issue_definitions') = 'ARRAY'),
typed AS (SELECT *, '$.issue_definitions[' || i || ']' AS place, row_number() OVER (PARTITION BY path, d ->> '$.issue_type' ORDER BY i) AS nth FROM defs),
keys AS (SELECT path, d, place, unnest(['issue_type', 'label', 'keywords', 'query_default', 'answer_template']) AS k FROM typed WHERE json_type(d) = 'OBJECT'),
conds AS (SELECT path, place, unnest(json_extract(d, '$.query_when[*]')) AS w, unnest(generate_series(0, CAST(json_array_length(d, '$.query_when') AS BIGINT) - 1)) AS n FROM typed WHERE json_type(d, '$.query_when') = 'ARRAY'),
placed AS (SELECT path, w, place || '.query_when[' || n || ']' AS place FROM conds)
SELECT path, '$' AS place, 'not JSON' AS error FROM c WHERE j IS NULL
UNION ALL SELECT path, '$.' || k, 'missing' FROM top WHERE json_type(j, '$.' || k) IS NULL
UNION ALL SELECT path, '$.' || k, 'not a list' FROM top WHERE k IN ('certificate_keywords', 'current_semester_keywords', 'document_types', 'issue_definitions') AND json_type(j, '$.' || k) <> 'ARRAY'
UNION ALL SELECT path, place, 'not an object' FROM typed WHERE json_type(d) <> 'OBJECT'
UNION ALL SELECT path, place || '.issue_type', 'repeated' FROM typed WHERE json_type(d, '$.issue_type') IS NOT NULL AND nth > 1
UNION ALL SELECT path, place || '.' || k, 'missing' FROM keys WHERE json_type(d, '$.' || k) IS NULL
UNION ALL SELECT path, place || '.keywords', 'not a list' FROM typed WHERE json_type(d, '$.keywords') <> 'ARRAY'
UNION ALL SELECT path, place || '.query_when', 'not a list' FROM typed WHERE json_type(d, '$.query_when') <> 'ARRAY'
UNION ALL SELECT path, place, 'not an object' FROM placed WHERE json_type(w) <> 'OBJECT'
UNION ALL SELECT path, place || '.' || k, 'missing' FROM (SELECT path, w, place, unnest(['condition_keywords', 'query']) AS k FROM placed WHERE json_type(w) = 'OBJECT') WHERE json_type(w, '$.' || k) IS NULL"""

# Links of pages.
LINKS = """
raw AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages),
links AS (SELECT page_id, unnest(ls) AS target, unnest(generate_series(0, len(ls) - 1)) AS pos FROM raw WHERE len(ls) > 0),
support AS (SELECT target, count(DISTINCT page_id) AS support FROM links WHERE target <> '/the' GROUP BY target)"""

# Orders as registry records.
RECORDS = """
rec AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'repeated' ELSE 'doc' || o_orderkey END AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 11 <> 0 THEN 'Order ' || o_orderkey END AS title,
    (['regulation', 'semester_notice', 'annual_notice', 'other'])[o_orderkey % 4 + 1] AS document_type, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE '' END AS status,
    CASE WHEN o_orderkey % 13 = 0 THEN [substr(o_orderpriority, 1, 1), 'x'] WHEN o_orderkey % 17 <> 0 THEN [substr(o_orderpriority, 1, 1)] END AS areas,
    CASE WHEN o_orderkey % 19 = 0 THEN '1998-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issued_date, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS effective_from,
    CASE WHEN o_orderkey % 5 = 0 THEN strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d') WHEN o_orderkey % 23 = 0 THEN 'soon' END AS effective_to
  FROM orders),
act AS (
  SELECT * FROM rec WHERE status = 'active' AND (TRY_CAST(effective_from AS DATE) IS NULL OR DATE '1998-06-15' >= TRY_CAST(effective_from AS DATE))
    AND (TRY_CAST(effective_to AS DATE) IS NULL OR DATE '1998-06-15' <= TRY_CAST(effective_to AS DATE)))"""

# Issues of user turns, and the sources that they lead to.
QUESTIONS = "uq AS (SELECT conv_id || '-' || turn AS question_id, min(text) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id, turn)"
ISSUES = f"""
{QUESTIONS},
nq AS (SELECT *, {norm("question")} AS n FROM uq),
al AS (
  SELECT question_id, 0 AS ord, 'english' AS issue_type, 'en' AS policy_area, CASE WHEN contains(n, 'tion') THEN 'the tion and' WHEN contains(n, 'ing') THEN 'ing the' ELSE 'the and of' END AS query, 'English' AS label
    FROM nq WHERE {has("n", "the ", "and ")} UNION ALL
  SELECT question_id, 1, 'german', 'de', 'der die und', 'German' FROM nq WHERE {has("n", " der ", " und ")} UNION ALL
  SELECT question_id, 2, 'french', 'fr', 'les de la', 'French' FROM nq WHERE {has("n", " les ", " dans ")}),
iss AS (
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY ord) - 1 AS issue_idx, issue_type, policy_area, query, label FROM al UNION ALL
  SELECT question_id, 0, 'generic', NULL, coalesce(question, ''), 'Anything' FROM nq WHERE question_id NOT IN (SELECT question_id FROM al))"""

# Candidates re-ranked by the rules of their issue.
SELECTED = """pri AS (
  SELECT *, CASE issue_type WHEN 'english' THEN CASE WHEN area <> 'english' THEN -1 WHEN sec IN ('1', '2', '3') THEN 3 WHEN contains(title, 'tion') THEN 2 ELSE 1 END
      WHEN 'german' THEN CASE WHEN area <> 'german' THEN -1 WHEN contains(title, 'sch') THEN 2 ELSE 1 END ELSE 0 END AS priority,
    CASE issue_type WHEN 'english' THEN CASE WHEN area = 'english' THEN 10 ELSE 0 END + CASE WHEN sec IN ('1', '2', '3') THEN 50 ELSE 0 END + CASE WHEN area <> 'english' AND sec <> '5' THEN -30 ELSE 0 END
      WHEN 'german' THEN CASE WHEN area = 'german' THEN 10 ELSE -30 END + CASE WHEN contains(title, 'sch') THEN 30 ELSE 0 END ELSE 0 END AS bonus
  FROM cand),
us AS (SELECT *, score + bonus AS final, priority >= 0 AND score + bonus > 0 AS useful FROM pri),
us2 AS (SELECT *, bool_or(useful) OVER (PARTITION BY question_id, issue_idx) AS has_some FROM us),
sel0 AS (
  SELECT question_id, issue_idx, issue_type, query, chunk_id, priority, CASE WHEN has_some THEN final ELSE score END AS score,
    row_number() OVER (PARTITION BY question_id, issue_idx ORDER BY CASE WHEN has_some THEN priority ELSE 0 END DESC, CASE WHEN has_some THEN final ELSE score END DESC, doc_id) AS rank
  FROM us2 WHERE useful OR NOT has_some),
sel AS (SELECT * FROM sel0 WHERE rank <= 3)"""

SOURCES = f"""
{ISSUES}, {CHUNKS}, {TERMS},
{lexical("SELECT DISTINCT query AS question_id, query, CAST(NULL AS VARCHAR) AS wanted FROM iss", k=8)},
cand AS (
  SELECT i.question_id, i.issue_idx, i.issue_type, i.query, b.chunk_id, c.doc_id, c.section_number AS sec, {norm("c.section_title")} AS title,
    CASE c.lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE c.lang END AS area, b.score, b.rank
  FROM iss i JOIN best b ON b.question_id = i.query JOIN chunks c USING (chunk_id)),
{SELECTED}"""

# Passages as questions, and the sources of their issues; bonus: SQL added to a score.
BENCH_ISSUES = ISSUES.replace(QUESTIONS, "uq AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question FROM benchmark)")
TEMPLATE = """CASE issue_type WHEN 'english' THEN CASE WHEN contains(query, 'tion') THEN 'Read the long English documents.' ELSE 'Read the English documents.' END
            WHEN 'german' THEN 'Read the German documents.' WHEN 'french' THEN 'Read the French documents.' ELSE 'Read on.' END"""
PRUNED = """
kp AS (SELECT *, CASE issue_type WHEN 'english' THEN (priority >= 2 AND contains(query, 'tion')) OR priority >= 3 WHEN 'german' THEN priority >= 2 ELSE true END AS keep FROM sel),
k2 AS (SELECT *, bool_or(keep) OVER (PARTITION BY question_id, issue_idx) AS any_kept FROM kp),
pr AS (SELECT question_id, issue_idx, issue_type, chunk_id, score, row_number() OVER (PARTITION BY question_id, issue_idx ORDER BY rank) AS rank FROM k2 WHERE keep OR (NOT any_kept AND rank = 1))"""


def answer_sources(bonus: str = "") -> str:
    return f"""{BENCH_ISSUES}, {CHUNKS}, {TERMS},
{lexical("SELECT question_id || '#' || issue_idx AS question_id, query, policy_area AS wanted FROM iss", bonus)},
cand AS (
  SELECT i.question_id, i.issue_idx, i.issue_type, i.query, b.chunk_id, c.doc_id, c.section_number AS sec, {norm("c.section_title")} AS title,
    CASE c.lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE c.lang END AS area, b.score, b.rank
  FROM iss i JOIN best b ON b.question_id = i.question_id || '#' || i.issue_idx JOIN chunks c USING (chunk_id)),
{SELECTED}, {PRUNED}"""


# Documents tagged with a token and citing the next, and the bonus by both.
GRAPH = f"""
dt AS (SELECT doc_id, list_reverse_sort(list_transform(({toks("text")})[1:8], lambda t: printf('%06d', length(t)) || t))[1] AS k FROM documents),
tagged AS (SELECT doc_id, substr(k, 7) AS tag FROM dt WHERE k IS NOT NULL),
active AS (SELECT DISTINCT CAST(b.item_id AS VARCHAR) AS question_id, t.tag FROM (SELECT item_id, {norm("text")} AS q FROM benchmark) b JOIN (SELECT DISTINCT tag FROM tagged) t ON contains(b.q, t.tag)),
hops AS (SELECT doc_id AS s, doc_id + 1 AS t FROM documents UNION SELECT doc_id + 1, doc_id FROM documents),
g0 AS (SELECT DISTINCT question_id, doc_id AS id FROM active JOIN tagged USING (tag)),
g1 AS (SELECT DISTINCT question_id, t AS id FROM g0 JOIN hops ON s = id),
g2 AS (SELECT DISTINCT question_id, t AS id FROM g1 JOIN hops ON s = id),
gb AS (SELECT question_id, CAST(id AS VARCHAR) AS chunk_id, max(bonus) AS bonus FROM (SELECT *, 1.5::DOUBLE AS bonus FROM g0 UNION ALL SELECT *, 1.5 FROM g1 UNION ALL SELECT *, 1.25 FROM g2) GROUP BY ALL)"""


def answer_sql() -> str:
    shown = f"{strip(f"replace(substr(c.text, 1, 300), {NL}, ' ')")} || CASE WHEN length(c.text) > 300 THEN '...' ELSE '' END"
    return f"""WITH {answer_sources()},
            uses AS (SELECT question_id, chunk_id, min(issue_idx * 100 + rank) AS use FROM pr GROUP BY ALL),
            cn AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY use) AS n FROM uses),
            de AS (SELECT p.question_id, p.issue_idx, p.rank, n, p.issue_idx * 100 + p.rank = use AS is_first, CASE WHEN c.section_title = '' THEN c.chunk_id ELSE c.section_title END AS title, c.chunk_id, c.doc_id, printf('%.2f', p.score) AS s, {shown} AS shown
              FROM pr p JOIN cn USING (question_id, chunk_id) JOIN chunks c USING (chunk_id)),
            ci AS (SELECT question_id, issue_idx, string_agg('* [' || n || '] ' || title || ' — ' || doc_id || ' — score ' || s, {NL} ORDER BY rank) AS cites FROM de GROUP BY ALL),
            se AS (SELECT question_id, string_agg('## ' || (issue_idx + 1) || '. ' || label || {NL} || {NL} || {TEMPLATE} || {NL} || {NL} || 'Căn cứ chính:' || {NL} || cites || {NL}, {NL} ORDER BY issue_idx) AS sections FROM ci JOIN iss USING (question_id, issue_idx) GROUP BY ALL),
            dl AS (SELECT question_id, string_agg('[' || n || '] ' || title || {NL} || '* chunk_id: ' || chunk_id || {NL} || '* doc_id: ' || doc_id || {NL} || '* source_pdf: N/A' || {NL} || '* score: ' || s || {NL} || '* preview: ' || shown || {NL}, {NL} ORDER BY n) AS details
              FROM de WHERE is_first GROUP BY ALL),
            al2 AS (SELECT question_id, count(*) AS n, string_agg(label, ', ' ORDER BY issue_idx) AS labels, string_agg(issue_type, '|' ORDER BY issue_idx) AS issues FROM iss GROUP BY ALL),
            ch AS (SELECT question_id, string_agg(chunk_id, '|' ORDER BY n) AS chunks FROM cn GROUP BY ALL)
            SELECT question_id, issues, coalesce(chunks, '') AS chunks, contains(nq.n, 'tion') AS warn_missing_notice,
              CASE WHEN sections IS NULL THEN 'Chưa tìm thấy quy định nào phù hợp.' ELSE '# Câu trả lời' || {NL} || {NL} || CASE WHEN al2.n > 1 THEN 'Câu hỏi có ' || al2.n || ' vấn đề: ' || labels || '.' ELSE 'Nhận định sơ bộ:' END || {NL} || {NL} || sections
                || {NL} || '# Căn cứ chi tiết' || {NL} || {NL} || details || {NL} || '# Gợi ý kiểm tra thêm' || {NL} || {NL} || CASE WHEN contains(nq.n, 'tion') THEN 'Not known yet.' ELSE 'Please check.' END END AS answer
            FROM nq JOIN al2 USING (question_id) LEFT JOIN se USING (question_id) LEFT JOIN dl USING (question_id) LEFT JOIN ch USING (question_id)"""


def regulation_sql() -> str:
    """The segments that each regulation is written with, merged by length."""
    segments = (
        ("preamble", "''", "''", "'__preamble'", "'Căn cứ ' || p"),
        ("chapter_header", "ch", "''", f"'__chuong_' || {slug('ch')}", "'## ' || ch"),
        ("dieu", "'Điều ' || art || '. Phạm vi ' || p", "art", "'__dieu_' || art", f"'## Điều ' || art || '. Phạm vi ' || p || '.' || {NL} || long"),
        ("dieu", "'Điều 20'", "'20'", "'__dieu_20'", f"'### Điều 20' || {NL} || 'ngắn'"),
        ("appendix", "'Phụ lục II. Bảng ' || p", "''", "'__phu_luc_ii'", f"'## Phụ lục II. Bảng ' || p || {NL} || 'dòng'"),
        ("appendix_sub", "'Nơi cấp chứng chỉ'", "''", "'__phu_luc_ii__noi_cap_chung_chi'", f"'### Nơi cấp chứng chỉ' || {NL} || long"),
        ("dieu", "'Điều 21. Trong phụ lục'", "'21'", "'__dieu_21'", f"'### Điều 21. Trong phụ lục' || {NL} || long"),
        # A letter that is a Roman digit in either case is taken for the label.
        ("appendix", "'Phụ lục ' || other || s", "''", f"'__phu_luc_' || CASE WHEN k % 4 = 0 THEN 'c' ELSE 'phu_luc_dac_biet_' || lower(s) END", f"'## Phụ lục ' || other || s || {NL} || '  thân bài' || {NL} || long"),
    )
    listed = " UNION ALL ".join(
        f"SELECT k, {i} AS seg, '{kind}' AS chunk_type, {title} AS section_title, {number} AS section_number, doc_id || {name} AS chunk_id, CASE WHEN {i} = 0 THEN '' ELSE ch END AS chapter_title, {body} AS text FROM r" for i, (kind, title, number, name, body) in enumerate(segments)
    )
    firsts = ", ".join(f"arg_min({c}, seg) AS {c}" for c in ("chunk_type", "section_title", "section_number", "chunk_id", "chapter_title"))
    return f"""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, CAST(o_custkey % 9 + 1 AS VARCHAR) AS art, repeat('x ', CAST(o_custkey % 60 AS INTEGER)) || 'y' AS long, 'Chương I. Quy định ' || o_orderpriority AS ch,
              CASE WHEN o_orderkey % 4 = 0 THEN 'chi tiết ' ELSE 'Đặc biệt ' END AS other, CASE WHEN o_orderkey % 3 <> 0 THEN 'QD-' || o_orderkey ELSE 'data_quy_dinh_' || o_orderkey END AS doc_id, CAST(o_custkey AS VARCHAR) AS decision_no,
              CASE WHEN o_orderkey % 5 = 0 THEN 's' WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'o' END || o_orderkey AS source_pdf FROM orders),
            sg AS ({listed}), st AS (SELECT *, seg = 0 OR length(text) >= 80 AS starts FROM sg), nb AS (SELECT *, CAST(sum(starts::INT) OVER (PARTITION BY k ORDER BY seg) AS BIGINT) AS chunk_no FROM st),
            mg AS (SELECT k, chunk_no, {firsts}, string_agg(text, {NL} || {NL} ORDER BY seg) AS text FROM nb GROUP BY k, chunk_no)
            SELECT r.doc_id, mg.chunk_id, mg.chunk_type, 'Quy định ' || k AS title, r.decision_no, mg.chapter_title, mg.section_title, mg.section_number, 'data/quy_dinh/' || k || '.md' AS source_path, r.source_pdf, mg.text, mg.chunk_no,
              length(mg.text) AS char_count, {words("mg.text")} AS word_count FROM mg JOIN r USING (k)"""


# Which documents hold which passage.
RELEVANT = f"""
rel AS (
  SELECT b.item_id AS question_id, CAST(d.doc_id AS VARCHAR) AS chunk_id
  FROM (SELECT item_id, array_to_string({toks("text")}, ' ') AS p, len({toks("text")}) AS n FROM benchmark) b
    JOIN (SELECT doc_id, array_to_string({toks("text")}, ' ') AS t FROM documents) d ON b.n > 0 AND contains(' ' || d.t || ' ', ' ' || b.p || ' ')),
cases AS (
  SELECT CAST(b.item_id AS VARCHAR) AS case_id, CAST(b.item_id + 1 AS VARCHAR) AS banned, coalesce(r.ids, []) AS ids
  FROM benchmark b LEFT JOIN (SELECT question_id, list(chunk_id ORDER BY CAST(chunk_id AS BIGINT)) AS ids FROM rel GROUP BY ALL) r ON r.question_id = b.item_id)"""


def _checks(name: str) -> str:
    """{name}: five checks per case over a CTE `best`."""
    return f"""
runs_{name} AS (SELECT CAST(question_id AS VARCHAR) AS case_id, list(chunk_id ORDER BY rank) AS got FROM best_{name} GROUP BY ALL),
{name} AS (
  SELECT case_id, true AS issue_types_pass, len(ids) = 0 OR coalesce(got[1], '') = ids[1] AS first_chunk_pass, len(ids) = 0 OR list_has_any(ids, got) AS chunk_any_pass, true AS answer_contains_pass,
    NOT list_contains(got, banned) AS negative_chunk_pass, got, ids
  FROM cases JOIN runs_{name} USING (case_id))"""


def _named(sql: str, name: str) -> str:
    """The CTEs of a retrieval with names of their own."""
    for cte in ("qt", "q", "hits", "phrase", "scores", "ranked", "best", "bags", "tf", "scopes", "stats", "dfs"):
        for left, right in ((f"\n{cte} AS", f"\n{cte}_{name} AS"), (f"FROM {cte} ", f"FROM {cte}_{name} "), (f"FROM {cte})", f"FROM {cte}_{name})"), (f"JOIN {cte} ", f"JOIN {cte}_{name} ")):
            sql = sql.replace(left, right)
    return sql.replace("qt.", f"qt_{name}.")


PASSED = "issue_types_pass AND first_chunk_pass AND chunk_any_pass AND answer_contains_pass AND negative_chunk_pass"


def _quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _phrases(*places: str) -> str:
    listed = rule_phrases()
    return " || ' / ' || ".join(f"([{_quoted(*listed)}])[CAST(({p}) % {len(listed)} AS INTEGER) + 1]" for p in places)


def _policy_chunks() -> str:
    kinds = _quoted(*POLICY_SELECTION)
    return f"""pc AS (
  SELECT l_orderkey, l_linenumber, l_quantity, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS chunk_id, CASE WHEN l_partkey % 3 = 0 THEN '{POLICY_DOCUMENT}' ELSE 'order' || l_orderkey END AS doc_id, CAST(24 + l_linenumber % 7 AS VARCHAR) AS sec,
    {_phrases("l_partkey")} AS title, upper({_phrases("l_partkey * 7", "l_suppkey * 31 + l_linenumber", "l_orderkey * 13 + l_partkey")}) AS body, ([{kinds}])[CAST(l_partkey % {len(POLICY_SELECTION)} AS INTEGER) + 1] AS area FROM lineitem)"""


def _policy_tags() -> str:
    """The rules as the data states them, a list of (condition, tag) for each
    field; the first of equal tags stays."""
    listed: dict[str, list[str]] = {f: [] for f in TAG_FIELDS}
    for g in POLICY_TAGS:
        gate = has("t", *g.gate) if g.document is None else f"({has('t', *g.gate)} OR (doc_id = '{g.document}' AND sec IN ({_quoted(*g.sections)})))"
        for r in g.rules:
            holds = " AND ".join([gate, *(has("t", *words) for words in (r.any_of, r.and_any_of) if words)])
            for name, tag in r.tags:
                listed[name].append(f"CASE WHEN {holds} THEN '{tag}' END")
    fields = ", ".join(f"list_filter([{', '.join(cases) or 'NULL'}], lambda x: x IS NOT NULL) AS {name}" for name, cases in listed.items())
    once = ", ".join(f"array_to_string(list_filter({name}, lambda x, i: list_position({name}, x) = i), '|') AS {name}" for name in listed)
    return f"WITH {_policy_chunks()}, f AS (SELECT *, {norm('title')} || ' ' || {norm('body')} AS t FROM pc), a AS (SELECT chunk_id, {fields} FROM f) SELECT chunk_id, {once} FROM a"


def _policy_issues() -> str:
    parts, generic = [], next(i for i in POLICY_ISSUES if i.issue_type == "generic")
    for k, i in enumerate(POLICY_ISSUES):
        if i.keywords:
            cases = "".join(f" WHEN {has('n', *words)} THEN {_quoted(query)}" for words, query in i.query_when)
            query = f"CASE{cases} ELSE {_quoted(i.query_default)} END" if cases else _quoted(i.query_default)
            parts.append(f"SELECT question_id, {k} AS ord, {_quoted(i.issue_type)} AS issue_type, {_quoted(i.policy_area)} AS policy_area, {query} AS query, {_quoted(i.label)} AS label FROM nq WHERE {has('n', *i.keywords)}")
    return f"""WITH q AS (SELECT o_orderkey AS question_id, 'Hỏi: ' || upper({_phrases("o_orderkey * 17", "o_custkey * 5 + 3")}) AS question FROM orders), nq AS (SELECT *, {norm("question")} AS n FROM q),
        al AS ({" UNION ALL ".join(parts)})
        SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY ord) - 1 AS issue_idx, issue_type, policy_area, query, label FROM al UNION ALL
        SELECT question_id, 0, 'generic', NULL, question, {_quoted(generic.label)} FROM nq WHERE question_id NOT IN (SELECT question_id FROM al)"""


def _when(w: When) -> str:
    parts = [f"{part} IN ({_quoted(*values)})" for part, values in (("sec", w.section),) if values] + [f"sec NOT IN ({_quoted(*w.not_section)})"] * bool(w.not_section)
    parts += [has(x, *words) for x, words in (("nt", w.title), ("nq", w.query)) if words] + [f"NOT {has(x, *words)}" for x, words in (("nt", w.no_title), ("nq", w.no_query)) if words]
    return " AND ".join(parts + ([] if w.area is None else [f"area {'=' if w.area else '<>'} kind"])) or "true"


def _policy_sources(most: int) -> str:
    """sel: the sources of each order's issue by the rules of its type."""
    kinds = list(POLICY_SELECTION)
    of = lambda parts: "CASE kind " + " ".join(f"WHEN '{k}' THEN {parts(POLICY_SELECTION[k])}" for k in kinds) + " END"
    priority = of(lambda s: "CASE" + "".join(f" WHEN {_when(w)} THEN {v}" for w, v in s.priorities) + " END")
    bonus = of(lambda s: "(" + " + ".join(f"CASE WHEN {_when(w)} THEN {v} ELSE 0 END" for w, v in s.bonuses) + ")")
    keep = of(lambda s: "(" + " OR ".join(f"(priority >= {least} AND {_when(w)})" for least, w in s.keep) + ")")
    alone = of(lambda s: "(" + (" OR ".join(f"(priority = {p} AND {_when(w)})" for p, w in s.not_alone) or "false") + ")")
    return f"""{_policy_chunks()},
        cd AS (SELECT l_orderkey AS question_id, chunk_id, doc_id, CAST(CAST(floor(l_quantity % 10) AS INTEGER) AS VARCHAR) AS sec, {norm("title")} AS nt, area, l_quantity AS own,
          ([{_quoted(*kinds)}])[CAST(l_orderkey % {len(kinds)} AS INTEGER) + 1] AS kind, {norm(_phrases("l_orderkey * 17", "l_orderkey * 5 + 3"))} AS nq FROM pc),
        p1 AS (SELECT *, {priority} AS priority, CAST({bonus} AS DOUBLE) AS bonus FROM cd),
        p2 AS (SELECT *, {keep} AS keep, {alone} AS not_alone, priority >= 0 AND own + bonus > 0 AS useful FROM p1),
        p3 AS (SELECT *, bool_or(useful) OVER (PARTITION BY question_id) AS has_some FROM p2),
        p4 AS (SELECT *, CASE WHEN has_some THEN own + bonus ELSE own END AS score FROM p3 WHERE useful OR NOT has_some),
        p5 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN has_some THEN priority ELSE 0 END DESC, score DESC, doc_id, CAST(sec AS INTEGER), chunk_id) AS rank FROM p4),
        sel AS (SELECT * FROM p5 WHERE rank <= {most})"""


def _policy_pruned(most: int) -> str:
    return f"""SELECT CAST({most} AS BIGINT) AS most, question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM (
        WITH {_policy_sources(most)}, k AS (SELECT *, keep AND NOT ({most} = 1 AND not_alone) AS stays FROM sel), k2 AS (SELECT *, bool_or(stays) OVER (PARTITION BY question_id) AS any_stays FROM k)
        SELECT question_id, chunk_id, rank FROM k2 WHERE stays OR (NOT any_stays AND rank = 1))"""


def _event_admission() -> str:
    return """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, n, event_id, true AS admitted, [us] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id, len(list_filter(r.held, lambda t: t > e.us - 86400000000)) < 2,
    CASE WHEN len(list_filter(r.held, lambda t: t > e.us - 86400000000)) < 2 THEN list_append(list_filter(r.held, lambda t: t > e.us - 86400000000), e.us) ELSE list_filter(r.held, lambda t: t > e.us - 86400000000) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, admitted FROM r"""


def oracle_sql() -> dict[str, str]:
    context = rf"'hoc ky ' || turn || ' ' || {norm('text')} || ' nam hoc 2024-2025'"
    return {
        "normalize_documents": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
        "token_counts": f"SELECT doc_id, len({toks('text')}) AS n_tokens, {words('text')} AS n_words, length(text) AS n_chars, {toks('text')}[1] AS first_token FROM documents",
        "slugs": f"SELECT 'page ' || page_id AS id, {slug('url')} AS slug FROM pages UNION ALL SELECT 'part ' || p_partkey, {slug('p_name')} FROM part",
        "previews": f"""WITH t AS (SELECT doc_id, text, {strip(f"replace(text, {NL}, ' ')")} AS flat, {strip(f"replace(substr(text, 1, 120), {NL}, ' ')")} AS cut, {strip("text")} AS stripped FROM documents)
            SELECT doc_id, CASE WHEN length(flat) > 300 THEN substr(flat, 1, 300) || '...' ELSE flat END AS short, CASE WHEN length(text) > 120 THEN cut || '…' ELSE cut END AS cut_first, stripped FROM t""",
        "date_checks": f"""WITH {RECORDS} SELECT ord, TRY_CAST(issued_date AS DATE) IS NOT NULL AS issued_ok, effective_to IS NULL OR TRY_CAST(effective_to AS DATE) IS NOT NULL AS to_ok,
            strftime(TRY_CAST(issued_date AS DATE), '%Y-%m-%d') AS issued FROM rec""",
        "natural_order": """WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS section FROM part)
            SELECT p_partkey, section, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN regexp_full_match(section, '[0-9]+') THEN 0 ELSE 1 END, TRY_CAST(section AS BIGINT) NULLS FIRST, section, p_partkey) AS place,
              printf('%.2f', p_retailprice) AS price FROM p""",
        "time_contexts": rf"""WITH t AS (SELECT conv_id, turn, {context} AS q, {norm("text")} AS n FROM conversations)
            SELECT conv_id, turn, {has("q", " die ", "of the")} AS current_semester,
              CAST(CASE WHEN regexp_matches(q, '\b(hk|hoc ky)\s*1\b') THEN 1 WHEN regexp_matches(q, '\b(hk|hoc ky)\s*2\b') THEN 2 WHEN regexp_matches(q, '\b(hk|hoc ky)\s*3\b') THEN 3 END AS INTEGER) AS semester,
              '2024-2025' AS academic_year, {has("q", "tion", "sch")} AS has_deadline_intent, {has("n", " die ", "tion", "eau")} AS needs_notice, {has("n", "ing ", "heit")} AS asks_now FROM t""",
        "frontmatter": "SELECT conv_id, turn, upper(role) AS role, CAST(turn AS VARCHAR) AS turn_text, 'a b' AS note, CAST(3 AS BIGINT) AS n_keys, text AS body FROM conversations",
        "ingested_documents": """WITH c AS (SELECT 'order-' || l_orderkey AS path, l_shipdate AS day_at, CASE WHEN l_returnflag <> 'R' THEN 'part ' || l_partkey || chr(10) || 'supplier ' || l_suppkey END AS text FROM lineitem),
            r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY day_at DESC, coalesce(sha256(text), '') DESC) AS n FROM c)
            SELECT path, strftime(day_at, '%Y-%m-%d') AS day, sha256(text) AS content_hash, CASE WHEN text IS NULL THEN 0 ELSE 1 END AS n_chunks, coalesce(length(text), 0) AS chars FROM r WHERE n = 1""",
        "config_validation": CONFIGS,
        "chunk_lines": f"WITH {LINES} SELECT doc_id, seg_id, chunk_type, chapter_title, section_title, text FROM segs",
        "regulation_chunks": regulation_sql(),
        "chunk_merge": f"WITH {LINES}, {MERGED} SELECT doc_id, chunk_no, chunk_type, text, length(text) AS char_count, {words('text')} AS word_count FROM merged",
        "chunks_per_doc": f"WITH {LINES}, {MERGED} SELECT doc_id, count(*) AS n_chunks FROM merged GROUP BY doc_id",
        "annotate_tags": f"""WITH {ANNOTATED} SELECT chunk_id, array_to_string(policy_area, '|') AS policy_area, array_to_string(action_tags, '|') AS action_tags, array_to_string(procedure_tags, '|') AS procedure_tags,
            array_to_string(evidence_groups, '|') AS evidence_groups, array_to_string(risk_tags, '|') AS risk_tags, array_to_string(requirement_tags, '|') AS requirement_tags FROM a""",
        "policy_tags": _policy_tags(),
        "policy_issues": _policy_issues(),
        "policy_selection": f"WITH {_policy_sources(3)} SELECT question_id, chunk_id, priority, score, rank FROM sel",
        "policy_pruning": f"{_policy_pruned(3)} UNION ALL {_policy_pruned(1)}",
        "tag_frequency": f"WITH {ANNOTATED} SELECT field, tag, count(*) AS n_chunks FROM tg WHERE field IN ('policy_area', 'action_tags', 'risk_tags') GROUP BY ALL",
        "cross_references": CITED + " SELECT chunk_id, level, pos, diem, khoan, dieu FROM cited",
        "reference_targets": CITED + """, t AS (SELECT c.*, doc || '__dieu_' || dieu AS article, EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = doc AND CAST(x.l_linenumber AS VARCHAR) = dieu) AS internal FROM cited c)
            SELECT chunk_id, level, pos, CASE WHEN internal OR khoan IS NULL THEN article ELSE article || '__khoan_' || khoan END AS target, internal FROM t""",
        "link_references": f"WITH {LINKS} SELECT page_id, pos, target FROM links",
        "link_support": f"WITH {LINKS} SELECT target, support FROM support",
        "external_nodes": f"WITH {LINKS} SELECT 'chunk:' || target AS node_id, 'ExternalReference' AS node_type, 'Điều ' || target AS label, support FROM support WHERE support >= 5",
        "isolated_references": f"WITH {LINKS} SELECT page_id, string_agg('Điều ' || target, '|' ORDER BY pos) AS refs FROM links JOIN support USING (target) WHERE support < 5 GROUP BY page_id",
        "reference_edges": f"""WITH {LINKS}, e AS (SELECT DISTINCT l.page_id, l.target, CASE WHEN l.target = '/the' THEN 'REFERENCES' ELSE 'EXTERNAL_REFERENCES' END AS edge_type
              FROM links l LEFT JOIN support s USING (target) WHERE l.target = '/the' OR s.support >= 5)
            SELECT 'chunk:' || page_id || '->chunk:' || target || ':' || edge_type AS edge_id, 'chunk:' || page_id AS source, 'chunk:' || target AS target, edge_type, target AS referenced FROM e""",
        "document_nodes": "SELECT DISTINCT 'document:' || source AS node_id, 'Document' AS node_type, source AS label FROM documents",
        "chunk_nodes": "SELECT 'chunk:d' || doc_id AS node_id, 'Chunk' AS node_type, 'd' || doc_id AS label, source AS doc_id, text FROM documents",
        "node_index": """WITH m AS (SELECT l_partkey, max(l_orderkey) AS label FROM lineitem GROUP BY ALL)
            SELECT 'part:' || l_partkey AS node_id, label, max(l_linenumber) AS line FROM m JOIN lineitem USING (l_partkey) WHERE l_orderkey = label GROUP BY ALL""",
        "tag_nodes": f"WITH {ANNOTATED} SELECT DISTINCT prefix || ':' || tag AS node_id, kind AS node_type, tag AS label, tag AS value FROM tg",
        "tag_edges": f"""WITH {ANNOTATED}, e AS (SELECT 'chunk:' || chunk_id AS source, prefix || ':' || tag AS target, edge AS edge_type FROM tg UNION ALL SELECT 'document:' || doc_id, 'chunk:' || chunk_id, 'DOCUMENT_HAS_CHUNK' FROM a)
            SELECT source || '->' || target || ':' || edge_type AS edge_id, source, target, edge_type FROM e""",
        "graph_summary": f"""WITH {ANNOTATED} SELECT 'node' AS part, kind, count(DISTINCT tag) AS n FROM tg GROUP BY ALL UNION ALL SELECT 'edge', edge, count(*) FROM tg GROUP BY ALL UNION ALL
            SELECT 'node', 'Chunk', count(*) FROM a UNION ALL SELECT 'node', 'Document', count(DISTINCT doc_id) FROM a UNION ALL SELECT 'edge', 'DOCUMENT_HAS_CHUNK', count(*) FROM a""",
        "chunks_by_tag": f"WITH {ANNOTATED} SELECT 'chunk:' || chunk_id AS node_id, chunk_id AS label FROM tg WHERE field = 'risk_tags' AND tag = 'secret' ORDER BY 'chunk:' || chunk_id || '->risk_tag:secret:CHUNK_HAS_RISK_TAG' LIMIT 10",
        "two_hop_bonus": f"""WITH {LINKS}, e AS (SELECT DISTINCT 'page:' || page_id AS s, 'link:' || target AS t FROM links), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
            seed AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS question_id, 'page:' || page_id AS node_id FROM pages),
            one AS (SELECT DISTINCT question_id, t AS node_id FROM seed JOIN b ON s = node_id), two AS (SELECT DISTINCT question_id, t AS node_id FROM one JOIN b ON s = node_id)
            SELECT question_id, node_id, max(bonus) AS bonus FROM (SELECT *, 1.5::DOUBLE AS bonus FROM seed UNION ALL SELECT *, 1.5 FROM one UNION ALL SELECT *, 1.25 FROM two) GROUP BY ALL""",
        "active_tags": f"WITH {GRAPH} SELECT question_id, 'action_tag:' || tag AS node_id FROM active",
        "graph_bonus": f"WITH {GRAPH} SELECT question_id, chunk_id, bonus FROM gb",
        "lexical_topk": f"WITH {CHUNKS}, {TERMS}, {lexical(PLAIN)} {TOP}",
        "lexical_filtered": f"WITH {CHUNKS}, {TERMS}, {lexical(BY_LANG)} {TOP}",
        "lexical_bonus": f"WITH {CHUNKS}, {TERMS}, {lexical(PLAIN, '+ CASE WHEN f.doc_id = p.question_id THEN 500 ELSE 0 END', 3)} {TOP}",
        "bm25_topk": f"WITH {CHUNKS}, {bm25(BY_LANG)} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM best",
        "index_topk": f"WITH {CHUNKS}, {TERMS}, {lexical(PLAIN)} {TOP}",
        "index_filtered": f"WITH {CHUNKS}, {TERMS}, {lexical(BY_LANG)} {TOP}",
        "index_bm25": f"WITH {CHUNKS}, {bm25(BY_LANG)} SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM best",
        "issue_inference": f"WITH {ISSUES} SELECT question_id, issue_idx, issue_type, policy_area, query, label FROM iss",
        "answer_templates": f"WITH {ISSUES} SELECT question_id, issue_type, {TEMPLATE} AS answer FROM iss",
        "missing_information": f"""WITH {ISSUES}, ak(issue_type, position, ask) AS (VALUES ('english', 0, 'Which source?'), ('english', 1, 'Which year?'), ('german', 0, 'Which state?')) SELECT question_id, issue_idx, CAST(position AS BIGINT) AS position, ask FROM iss JOIN ak USING (issue_type)""",
        "select_sources": f"WITH {SOURCES} SELECT question_id, issue_type, chunk_id, priority, score, rank FROM sel",
        "prune_sources": f"""WITH {SOURCES},
            kp AS (SELECT *, CASE issue_type WHEN 'english' THEN (priority >= 2 AND contains(query, 'tion')) OR priority >= 3 WHEN 'german' THEN priority >= 2 ELSE true END AS keep FROM sel),
            k2 AS (SELECT *, bool_or(keep) OVER (PARTITION BY question_id, issue_idx) AS has_some FROM kp)
            SELECT question_id, issue_type, chunk_id, score, row_number() OVER (PARTITION BY question_id, issue_idx ORDER BY rank) AS rank FROM k2 WHERE keep OR (NOT has_some AND rank = 1)""",
        "multi_issue_union": f"""WITH {SOURCES}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY issue_idx, rank) AS n FROM sel)
            SELECT question_id, issue_type, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY issue_idx, rank) AS position FROM o WHERE n = 1""",
        "raw_ranking": f"""WITH {SOURCES}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY issue_idx, rank) AS n FROM cand),
            z AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, issue_idx, rank) AS position FROM o WHERE n = 1) SELECT * FROM z WHERE position <= 5""",
        "citation_numbers": f"""WITH {SOURCES}, u AS (SELECT question_id, chunk_id, min(issue_idx * 100 + rank) AS use FROM sel GROUP BY ALL),
            c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY use) AS citation FROM u) SELECT s.question_id, s.issue_type, s.chunk_id, c.citation FROM sel s JOIN c USING (question_id, chunk_id)""",
        "answers": answer_sql(),
        "graph_sources": f"""WITH {GRAPH}, {answer_sources("+ coalesce((SELECT max(g.bonus) FROM gb g WHERE g.question_id = split_part(p.question_id, '#', 1) AND g.chunk_id = f.chunk_id), 0)")} SELECT question_id, issue_type, chunk_id, score, rank FROM pr""",
        "answer_metadata": f"""WITH {QUESTIONS} SELECT question_id, 'tables' AS domain_id, (SELECT count(*) FROM documents) AS chunks_loaded, true AS uses_document_registry, false AS uses_graph, 'lexical_v0' AS retrieval_backend,
              {has(norm("question"), "hoc ky nay", "deadline", "thoi han", "khi nao", "bao gio", "lich thi", "ke hoach")} AS is_time_sensitive FROM uq""",
        "active_documents": f"WITH {RECORDS} SELECT ord, doc_id, document_type FROM act",
        "validity_by_day": f"""WITH {RECORDS}, a AS (SELECT document_type IN ('semester_notice', 'annual_notice') AS notice, areas, coalesce(TRY_CAST(effective_from AS DATE), DATE '0001-01-01') AS b, coalesce(TRY_CAST(effective_to AS DATE), DATE '9999-12-31') AS e FROM rec WHERE status = 'active'),
            q AS (SELECT l_orderkey || '-' || l_linenumber AS question_id, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS VARCHAR) END AS area FROM lineitem), k AS (SELECT DISTINCT day, area FROM q),
            c AS (SELECT k.day, k.area, count(a.b) AS n, count(a.b) FILTER (notice) AS m FROM k LEFT JOIN a ON k.day BETWEEN a.b AND a.e AND (k.area IS NULL OR list_contains(a.areas, k.area)) GROUP BY ALL)
            SELECT question_id, strftime(q.day, '%Y-%m-%d') AS day, n AS active_documents, m AS active_notices FROM q JOIN c ON c.day = q.day AND c.area IS NOT DISTINCT FROM q.area""",
        "current_notices": f"WITH {RECORDS} SELECT doc_id, array_to_string(areas, '|') AS areas FROM act WHERE document_type IN ('semester_notice', 'annual_notice')",
        "missing_notice": f"""WITH {RECORDS}, {QUESTIONS}, nt AS (SELECT doc_id, areas, doc_id IN (SELECT doc_id FROM rec WHERE ord IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS held FROM act WHERE document_type IN ('semester_notice', 'annual_notice')),
            pa AS (SELECT area, count(*) AS n, sum(held::INT) AS m FROM (SELECT DISTINCT unnest(areas) AS area, doc_id, held FROM nt) GROUP BY area), tot AS (SELECT count(*) AS n, coalesce(sum(held::INT), 0) AS m FROM nt),
            qs AS (SELECT question_id, CASE WHEN length(question) % 7 < 6 THEN CAST(length(question) % 7 AS VARCHAR) END AS area,
              length(question) % 2 = 0 OR {has(norm("question"), "hoc ky nay", "deadline", "thoi han", "khi nao", "bao gio", "lich thi", "ke hoach")} AS needs FROM uq)
            SELECT question_id, needs AS needs_notice, CAST(CASE WHEN qs.area IS NULL THEN tot.n ELSE coalesce(pa.n, 0) END AS BIGINT) AS active_notices, CAST(CASE WHEN qs.area IS NULL THEN tot.m ELSE coalesce(pa.m, 0) END AS BIGINT) AS covered_notices,
              needs AND CASE WHEN qs.area IS NULL THEN tot.m ELSE coalesce(pa.m, 0) END = 0 AS warn FROM qs LEFT JOIN pa ON pa.area = qs.area CROSS JOIN tot""",
        "notice_alerts": f"""WITH {RECORDS}, {QUESTIONS}, nt AS (SELECT doc_id, areas, doc_id IN (SELECT doc_id FROM rec JOIN orders ON ord = o_orderkey WHERE o_orderpriority < '3' AND doc_id <> 'repeated') AS held FROM act WHERE document_type IN ('semester_notice', 'annual_notice')),
            qs AS (SELECT question_id, CASE WHEN length(question) % 7 < 6 THEN CAST(length(question) % 7 AS VARCHAR) END AS area,
              length(question) % 2 = 0 OR {has(norm("question"), "hoc ky nay", "deadline", "thoi han", "khi nao", "bao gio", "lich thi", "ke hoach")} AS needs FROM uq),
            pair AS (SELECT DISTINCT question_id, doc_id, held FROM qs JOIN nt ON needs AND (area IS NULL OR list_contains(areas, area)))
            SELECT question_id, doc_id FROM pair WHERE question_id NOT IN (SELECT question_id FROM pair WHERE held)""",
        "registry_validation": f"""WITH {RECORDS} SELECT doc_id AS id, ord, 'missing title' AS error FROM rec WHERE title IS NULL UNION ALL SELECT doc_id, ord, 'missing status' FROM rec WHERE status = '' UNION ALL
            SELECT doc_id, ord, 'bad date issued_date' FROM rec WHERE TRY_CAST(issued_date AS DATE) IS NULL UNION ALL
            SELECT doc_id, ord, 'bad date effective_to' FROM rec WHERE effective_to IS NOT NULL AND TRY_CAST(effective_to AS DATE) IS NULL UNION ALL
            SELECT doc_id, ord, 'duplicate id' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM rec) WHERE n > 1""",
        "document_priority": f"""WITH {RECORDS} SELECT ord, doc_id, row_number() OVER (ORDER BY CASE WHEN coalesce(list_contains(areas, '1'), false) THEN 0 ELSE 1 END,
            CASE document_type WHEN 'semester_notice' THEN 0 WHEN 'annual_notice' THEN 1 WHEN 'regulation' THEN 2 ELSE 3 END, ord) AS rank FROM act""",
        "passage_matches": f"WITH {RELEVANT} SELECT question_id, chunk_id FROM rel",
        "eval_checks": f"""WITH {CHUNKS}, {TERMS}, {_named(lexical(PLAIN), "lex")}, {RELEVANT}, {_checks("lex")}
            SELECT case_id, issue_types_pass, first_chunk_pass, chunk_any_pass, answer_contains_pass, negative_chunk_pass, {PASSED} AS passed FROM lex""",
        "ir_metrics": f"""WITH {CHUNKS}, {TERMS}, {_named(lexical(PLAIN), "lex")}, {RELEVANT}, runs AS (SELECT CAST(question_id AS VARCHAR) AS case_id, list(chunk_id ORDER BY rank) AS got FROM best_lex GROUP BY ALL),
            s AS (SELECT ids, coalesce(got, []) AS got FROM cases LEFT JOIN runs USING (case_id) WHERE len(ids) > 0),
            m AS (SELECT CASE WHEN list_has_any(ids, got) THEN 1.0::DOUBLE ELSE 0 END AS recall, CASE WHEN list_contains(got, ids[1]) THEN 1.0::DOUBLE / list_position(got, ids[1]) ELSE 0 END AS rr,
              coalesce(list_sum([CASE WHEN list_contains(ids, got[i]) THEN 1 / log2(i + 1) ELSE 0 END for i in range(1, 6) if i <= len(got)]), 0) / list_sum([1 / log2(i + 1) for i in range(1, 6) if i <= len(ids)]) AS ndcg FROM s)
            SELECT coalesce(round(avg(recall), 6), 0) AS recall_at_k, coalesce(round(avg(rr), 6), 0) AS mrr, coalesce(round(avg(ndcg), 6), 0) AS ndcg_at_k, count(*) AS recall_n, count(*) AS mrr_n, count(*) AS ndcg_n FROM m""",
        "backend_compare": f"""WITH {CHUNKS}, {TERMS}, {_named(lexical(PLAIN), "lex")}, {_named(bm25(PLAIN), "bm")}, {RELEVANT}, {_checks("lex")}, {_checks("bm")},
            b AS (SELECT 'lexical_v0' AS backend, * FROM lex UNION ALL SELECT 'bm25_like_v0', * FROM bm)
            SELECT backend, count(*) AS total_cases, CAST(sum(({PASSED})::INT) AS BIGINT) AS n_passed, round(avg(({PASSED})::INT), 6) AS pass_rate, round(avg(first_chunk_pass::INT), 6) AS first_chunk_pass_rate,
              round(avg(negative_chunk_pass::INT), 6) AS negative_chunk_pass_rate FROM b GROUP BY backend""",
        "disagreements": f"""WITH {CHUNKS}, {TERMS}, {_named(lexical(PLAIN), "lex")}, {_named(bm25(PLAIN), "bm")}, {RELEVANT}, {_checks("lex")}, {_checks("bm")},
            b AS (SELECT case_id, 'lexical_v0' AS backend, {PASSED} AS passed FROM lex UNION ALL SELECT case_id, 'bm25_like_v0', {PASSED} FROM bm)
            SELECT case_id, string_agg(backend || ':' || passed, '|' ORDER BY backend) AS results FROM b GROUP BY case_id HAVING count(DISTINCT passed) > 1""",
        "failure_diagnosis": f"""WITH {CHUNKS}, {TERMS}, {_named(lexical(PLAIN), "lex")}, {RELEVANT}, {_checks("lex")}
            SELECT case_id, concat_ws('|', CASE WHEN NOT issue_types_pass THEN 'issue_types_pass' END, CASE WHEN NOT first_chunk_pass THEN 'first_chunk_pass' END, CASE WHEN NOT chunk_any_pass THEN 'chunk_any_pass' END,
              CASE WHEN NOT answer_contains_pass THEN 'answer_contains_pass' END, CASE WHEN NOT negative_chunk_pass THEN 'negative_chunk_pass' END) AS failed FROM lex WHERE NOT ({PASSED})""",
        "one_case": f"WITH {RELEVANT} SELECT case_id, ids[1] AS expected_first_chunk_id, array_to_string(ids, '|') AS expected FROM cases WHERE case_id = '7'",
        "timed_runs": """WITH t AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY ALL)
            SELECT 'backend ' || conv_id % 2 AS backend, count(*) AS total_cases, CAST(sum((n % 3 <> 0)::INT) AS BIGINT) AS n_passed, round(avg((n % 3 <> 0)::INT), 6) AS pass_rate, round(avg((n % 3 <> 0)::INT), 6) AS first_chunk_pass_rate,
              round(avg((n % 3 <> 0)::INT), 6) AS negative_chunk_pass_rate, round(avg(n % 70), 6) AS avg_latency_ms FROM t GROUP BY ALL""",
        "request_statuses": rf"""SELECT conv_id, turn, CASE WHEN NOT (length(coalesce(text, '')) <= 2000 AND regexp_matches(coalesce(text, ''), '\S') AND turn * 3 BETWEEN 1 AND 10) THEN 422 WHEN length(text) % 5 = 4 THEN 503 WHEN conv_id % 3 = 0 THEN 500 ELSE 200 END AS status
            FROM conversations""",
        "request_validation": rf"""SELECT conv_id, turn, CAST(turn * 3 AS INTEGER) AS top_k, CASE WHEN length(coalesce(text, '')) <= 2000 AND regexp_matches(coalesce(text, ''), '\S') AND turn * 3 BETWEEN 1 AND 10 THEN 200 ELSE 422 END AS status FROM conversations""",
        "rate_window": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""",
        "rate_limit_admitted": _event_admission(),
    }
