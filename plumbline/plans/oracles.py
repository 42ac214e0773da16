"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from plumbline.functions.paths import IGNORED, SUFFIXES
from plumbline.functions.text import FILE_STOPWORDS, SEPARATORS, STOPWORDS


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
TERMS = f"list_distinct(list_filter({TOKENS}, lambda t: length(t) > 1 AND t NOT IN ({_list(STOPWORDS)})))"
# RE2 has no lookaround: a mark between the two anchors, which never overlap, does instead.
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')), lambda s: s <> '')"
STEM = "CASE WHEN regexp_full_match({0}, '[a-z]{{3,}}s') AND NOT {0} LIKE '%ss' THEN {0}[:-2] ELSE {0} END"
FILE_TOKENS = (
    "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_.][a-z0-9]+)*'), lambda w: list_concat("
    "list_transform(regexp_split_to_array(w, '[-_.]'), lambda p: " + STEM.format("p").replace("{", "{{").replace("}", "}}") + "), "
    "CASE WHEN regexp_matches(w, '[-_.]') AND len(list_filter(regexp_split_to_array(w, '[-_.]'), lambda p: NOT regexp_full_match(p, '[0-9]+'))) > 0 "
    "THEN [regexp_replace(w, '[-_.]', '', 'g')] ELSE [] END)))"
)
GRADED = "upper(replace(regexp_replace({0}, '" + SEPARATORS + "', '', 'g'), 'ß', 'SS'))"
IDENTIFIERS = "list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*'), lambda t: regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]')), lambda t: " + GRADED.format("t") + "), lambda t: length(t) >= 4))"
UNIT = r"(?i)^([+-]?[0-9]+(?:[.,][0-9]+)*)\s*(?:°\s*[cf]?|%|degrees?(?:\s*(?:c|f|celsius|fahrenheit))?|celsius|fahrenheit|milliseconds?|seconds?|secs?|ms|s|volts?|v|watts?|w|amps?|a|[kmg]?hz|[kmgt]b|c|f)$"
STRIP = "coalesce(nullif(regexp_extract(trim({0}), '" + UNIT + "', 1), ''), trim({0}))"
HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
NO_SCHEME = "regexp_replace(url, '^[a-z]+://', '')"
WALK_KEY = "list_aggregate(list_concat(list_transform(string_split({0}, '/')[:-2], lambda p: '1' || p), ['0' || string_split({0}, '/')[-1]]), 'string_agg', chr(1))"
QUOTES = "`''\"“”‘’ "

FILES = f"""files AS (
  SELECT page_id, page_id % 13 <> 0 AS indexed, {HOST} || '/spec_' || (page_id % 40)
    || CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 17 = 0 THEN '_r20250101' || lpad(CAST(page_id AS VARCHAR), 8, '0') WHEN page_id % 3 = 0 THEN '_rev_' || (['a','b','c','d','e'])[page_id % 5 + 1] ELSE '_r' || (page_id % 5) END
    || CASE WHEN page_id % 7 = 0 THEN '_WITHDRAWN' ELSE '' END || (['.pdf','.docx','.txt'])[page_id % 3 + 1] AS path
  FROM pages)"""
STATUS = r"(?i)[_\-. ]*(withdrawn|superseded|obsolete|deprecated|draft|archived?|old)"
REVISION = r"(?i)[_\-. ]+(?:rev(?:ision)?|r|v|version)[_\-. ]?([0-9]+[a-z]?[0-9]*|[a-z][0-9]*)$"
REVISED = rf"""
stems AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', '') AS stem FROM files),
bares AS (SELECT *, regexp_replace(stem, '{STATUS}', '', 'g') AS bare FROM stems),
revised AS (
  SELECT *, regexp_extract(path, '^(.*/)[^/]*$', 1) || regexp_replace(lower(regexp_replace(bare, '{REVISION}', '', 'g')), '^[_\-. ]+|[_\-. ]+$', '', 'g') AS family,
    regexp_extract(bare, '{REVISION}', 1) AS token, regexp_matches(stem, '{STATUS}') AS withdrawn
  FROM bares),
keyed AS (
  SELECT *, CASE WHEN token = '' THEN [0::HUGEINT] ELSE list_concat(
      [CAST(coalesce(list_sum(list_transform(list_filter(string_split(regexp_replace(lower(token), '[^a-z]', '', 'g'), ''), lambda c: c <> ''), lambda c: ascii(c) - 96)), 0) AS HUGEINT)],
      list_transform(regexp_extract_all(token, '[0-9]+'), lambda d: CAST(d AS HUGEINT))) END AS revision
  FROM revised)"""
MARKDOWN = r"md AS (SELECT doc_id, regexp_replace(text, '\n(The?|In|Of|[DEL][ae]s?) ', chr(10) || chr(10) || '## \1 heading' || chr(10), 'g') AS text FROM documents)"


def _bm25(tokens: str, text: str, k1: float) -> str:
    return f"""
tok AS (SELECT doc_id, source, {tokens.format(text)} AS ts FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
q AS (SELECT item_id AS query_id, unnest(list_distinct({tokens.format("text")})) AS term FROM benchmark),
scored AS (
  SELECT query_id, tf.doc_id AS chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - 0.75 + 0.75 * len(ts) / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN tok ON tok.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL)"""


def _vectors(name: str, source: str, key: str) -> str:
    return f"""
{name}_g AS (SELECT {key} AS id, md5(g) AS h FROM (SELECT {key}, unnest(list_transform(range(1, greatest(1, length(text) - 2) + 1), lambda i: substring(lower(text), i, 3))) AS g FROM {source})),
{name}_c AS (SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 256 AS INTEGER) AS b, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_g GROUP BY ALL),
{name} AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_c WHERE x <> 0)"""


HYBRID = f"""WITH {_bm25(TOKENS, "text", 1.5)},
few AS (SELECT * FROM benchmark WHERE item_id % 50 = 0),
{_vectors("dv", "documents", "doc_id")},
{_vectors("qv", "few", "item_id")},
lex AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS lexical_rank
  FROM scored WHERE query_id % 50 = 0 QUALIFY lexical_rank <= 16),
dots AS (SELECT qv.id AS query_id, dv.id AS chunk_id, sum(dv.x * qv.x) AS s FROM dv JOIN qv USING (b) GROUP BY ALL HAVING sum(dv.x * qv.x) > 0),
den AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS dense_rank FROM dots QUALIFY dense_rank <= 16),
fu AS (
  SELECT query_id, chunk_id, lexical_rank, dense_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) AS f
  FROM lex FULL JOIN den USING (query_id, chunk_id)),
hybrid AS (
  SELECT query_id, chunk_id, lexical_rank, dense_rank, round(f, 6) AS fused_score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, lexical_rank ASC NULLS LAST, dense_rank) AS fused_rank
  FROM fu QUALIFY fused_rank <= 8)"""

CLAIMS = f"""
chunks AS (SELECT conv_id || '::' || turn AS chunk_id, max(text) AS chunk_text FROM conversations GROUP BY conv_id, turn),
said AS (SELECT conv_id, turn, max(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY ALL),
pieces AS (SELECT conv_id, turn, ss, unnest(range(len(ss))) AS pos FROM (SELECT conv_id, turn, {SENTENCES.format("text")} AS ss FROM said)),
claims AS (
  SELECT conv_id || '::' || turn || '::' || pos AS claim_id, conv_id AS query_id, turn, pos, ss[pos + 1] AS text,
    CASE WHEN pos % 9 = 8 THEN [] WHEN (conv_id + turn + pos) % 4 = 0 THEN [conv_id || '::' || (turn - 1), conv_id || '::' || turn]
      WHEN (conv_id + turn + pos) % 4 = 1 THEN [conv_id || '::' || turn] WHEN (conv_id + turn + pos) % 4 = 2 THEN ['none'] ELSE [conv_id || '::' || (turn - 1), 'none'] END AS cited
  FROM pieces),
met AS (
  SELECT claim_id, p, chunk_id, chunk_text, len(terms) AS n, CASE WHEN len(terms) = 0 THEN 0 ELSE len(list_intersect(terms, {TERMS.format("chunk_text")}))::DOUBLE / len(terms) END AS share
  FROM (SELECT claim_id, {TERMS.format("text")} AS terms, unnest(cited) AS chunk_id, unnest(range(len(cited))) AS p FROM claims) JOIN chunks USING (chunk_id)),
best AS (SELECT claim_id, count(*) OVER (PARTITION BY claim_id) AS k, share, chunk_id, chunk_text, n FROM met QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY share DESC, p) = 1),
covered AS (
  SELECT claim_id, query_id, turn, pos, text, len(cited) AS n_cited, coalesce(k, 0) AS n_resolved, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE round(share, 4) END AS coverage_score,
    coalesce(n, 0) > 0 AND share >= 0.55 AS supported, CASE WHEN n > 0 THEN chunk_id END AS best_chunk_id, CASE WHEN n > 0 THEN chunk_text END AS best_text
  FROM claims LEFT JOIN best USING (claim_id)),
stated AS (SELECT *, CASE WHEN n_cited = 0 THEN 'uncited' WHEN n_resolved > 0 AND supported THEN 'supported' ELSE 'unsupported' END AS status FROM covered)"""

MENTIONS = """
seg AS (SELECT p_partkey, p_brand AS source, 'part | p_partkey: ' || p_partkey || ' | p_type: ' || trim(p_type) || ' | p_size: ' || p_size || ' | p_brand: ' || trim(p_brand) AS text FROM part),
ws AS (SELECT p_partkey, source, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '^[.,;:()]+|[.,;:()]+$', '', 'g'))) AS w FROM seg),
placed AS (SELECT p_partkey, source, w, unnest(range(len(w))) AS i FROM ws),
mentions AS (
  SELECT p_partkey // 8 AS query_id, p_partkey * 1000 + i AS ord, source, w[i + 1] AS value,
    list_filter(list_concat(w[greatest(1, i - 5):i], w[i + 2:i + 7]), lambda x: length(x) > 2) AS c
  FROM placed WHERE regexp_full_match(w[i + 1], '[0-9]{1,4}'))"""

CASES = f"""
cases AS (
  SELECT doc_id, 'v' || (doc_id % 3) AS prompt_version, quality = 0 AS expects_abstain, doc_id % 5 = 0 OR toxic = 1 AS abstained,
    {TERMS.format("text")} AS e, {TERMS.format("coalesce(list_aggregate(list_filter(w, lambda x, i: ((i - 1 + doc_id) % 3 = 0) = (doc_id % 2 = 1)), 'string_agg', ' '), '')")} AS a,
    (doc_id % 10) / 10 AS faithfulness, (doc_id % 4) / 4 AS grounded_ratio, (n_chars % 100)::DOUBLE AS latency_ms, n_chars AS tokens
  FROM (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM documents) JOIN labels USING (doc_id)),
decided AS (
  SELECT *, CASE WHEN expects_abstain THEN abstained WHEN abstained THEN false WHEN len(e) = 0 THEN false ELSE len(list_intersect(e, a)) / len(e) >= 0.6 END AS correct FROM cases)"""


def _kind() -> str:
    suffix = r"lower(regexp_extract(bare, '\.([A-Za-z0-9]+)$', 1))"
    return " ".join(f"WHEN {suffix} IN ({_list(names)}) THEN '{kind}'" for kind, names in SUFFIXES.items())


def _row(table: str, key: str, cells: list[str]) -> str:
    kind = lambda c: "DECIMAL(18, 2)) AS VARCHAR" if c in ("p_retailprice", "s_acctbal", "c_acctbal") else "VARCHAR"
    text = lambda c: f"CAST(CAST({c} AS {kind(c)})" if kind(c) != "VARCHAR" else f"CAST({c} AS VARCHAR)"
    shown = ", ".join(f"CASE WHEN coalesce(trim({text(c)}), '') <> '' THEN '{c}: ' || trim({text(c)}) END" for c in cells)
    return f"SELECT '{table}:' || {key} AS row_key, concat_ws(' | ', '{table}', {shown}) AS segment FROM {table}"


ANSWERS = f"""{CLAIMS},
asked AS (SELECT DISTINCT conv_id AS query_id FROM conversations),
per AS (SELECT query_id, count(*) AS n, count(*) FILTER (status IN ('unsupported', 'uncited')) / count(*) AS r, count(*) FILTER (status = 'supported') / count(*) AS gr, coalesce(string_agg(text, ' ' ORDER BY turn, pos) FILTER (status = 'supported'), '') AS a FROM stated GROUP BY query_id),
early AS (
  SELECT query_id, n, r, gr, a, CASE WHEN query_id % 13 = 5 THEN 'no_retrieval_results' WHEN query_id % 11 = 3 THEN 'unparseable_generation' WHEN query_id % 7 = 2 THEN 'model_abstained' END AS e FROM asked LEFT JOIN per USING (query_id)),
outcomes AS (SELECT *, coalesce(e, CASE WHEN n IS NULL OR r > 0.2 THEN 'unsupported_ratio_exceeded' ELSE 'answered' END) AS outcome FROM early)"""
CONTRACT = f"""{_bm25(FILE_TOKENS, "source || chr(10) || text", 1.4)},
raw AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM scored QUALIFY r <= 60),
adj AS (SELECT query_id, chunk_id, source AS path, r, CASE WHEN source IN ('src0', 'src3', 'src7') THEN score * 0.4 ELSE score END AS score FROM raw JOIN documents ON doc_id = chunk_id),
cap AS (SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, r) <= 3),
hits AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank, chunk_id, path FROM cap QUALIFY rank <= 10)"""

def _hop(name: str, asked: str) -> str:
    """File-corpus search of the questions in ``asked``: its hits are ``{name}``."""
    return f"""
{name}_q AS (SELECT query_id, unnest(list_distinct({FILE_TOKENS.format("text")})) AS term FROM {asked}),
{name}_s AS (
  SELECT query_id, tf.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.75 + 0.75 * len(ts) / avgdl))) AS score
  FROM {name}_q JOIN tf USING (term) JOIN df USING (term) JOIN tok ON tok.chunk_id = tf.chunk_id CROSS JOIN st GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM {name}_s QUALIFY r <= 60),
{name}_a AS (SELECT query_id, chunk_id, path, r, CASE WHEN superseded THEN score * 0.4 ELSE score END AS score FROM {name}_r JOIN cs USING (chunk_id)),
{name}_c AS (SELECT * FROM {name}_a QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, r) <= 3),
{name} AS MATERIALIZED (SELECT query_id, chunk_id, path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank FROM {name}_c QUALIFY rank <= 10)"""


PRICE = "CAST(CAST(p_retailprice AS DECIMAL(20, 2)) AS VARCHAR)"
EXPANDED = f"""
cs AS MATERIALIZED (
  SELECT *, contains(path, '_r1.') AS superseded FROM (
    SELECT p_partkey * 2 AS chunk_id, concat_ws(' ', p_name, p_type, 'slot' || p_partkey, 'PN-' || p_partkey) AS text, 'parts/' || lower(p_brand) || '_r' || (p_partkey % 2 + 1) || '.csv' AS path FROM part
    UNION ALL SELECT p_partkey * 2 + 1, concat_ws(' ', 'PN-' || p_partkey, 'retail price', {PRICE}), 'stock/' || (p_partkey % 97) || '.txt' FROM part)),
asked AS (SELECT p_partkey AS query_id, 'what is the retail price of ' || p_name || ' in slot' || p_partkey AS text FROM part WHERE p_partkey % 50 = 0),
tok AS MATERIALIZED (SELECT chunk_id, {FILE_TOKENS.format("path || chr(10) || text")} AS ts FROM cs),
tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),{_hop("h1", "asked")},
ids AS MATERIALIZED (SELECT chunk_id, path, unnest({IDENTIFIERS.format("text")}) AS ident FROM cs),
few AS (SELECT ident, count(DISTINCT path) AS n_files FROM ids GROUP BY ident HAVING count(DISTINCT path) <= 12),
named AS (SELECT DISTINCT query_id, ident FROM h1 JOIN ids USING (chunk_id) JOIN asked USING (query_id) WHERE rank <= 5 AND NOT contains({GRADED.format("asked.text")}, ident)),
rare AS (SELECT query_id, ident, row_number() OVER (PARTITION BY query_id ORDER BY n_files, ident) AS k FROM named JOIN few USING (ident) QUALIFY k <= 6),
again AS (SELECT query_id, string_agg(ident, ' ' ORDER BY k) || ' ' || any_value(text) AS text FROM rare JOIN asked USING (query_id) GROUP BY query_id),{_hop("h2", "again")},
hops AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 ANTI JOIN h1 USING (query_id, chunk_id)),
expanded AS MATERIALIZED (SELECT query_id, chunk_id, path, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS rank FROM hops QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) <= 16)"""
FILE_TERMS = f"list_distinct(list_filter({FILE_TOKENS}, lambda t: length(t) > 1 AND t NOT IN ({_list(FILE_STOPWORDS)})))"
HOLDS = lambda text, value: f"({GRADED.format(value)} <> '' AND contains({GRADED.format(text)}, {GRADED.format(value)}))"
VERIFIED = f"""{EXPANDED},
replied AS MATERIALIZED (
  SELECT p_partkey AS query_id, asked.text AS question, {FILE_TERMS.format("asked.text")} AS terms, CASE WHEN p_partkey % 150 = 0 THEN '0.01' WHEN p_partkey % 200 = 0 THEN '' ELSE {PRICE} END AS answer,
    'stock/' || (p_partkey % 97) || '.txt' AS one, 'parts/' || lower(p_brand) || '_r' || (p_partkey % 2 + 1) || '.csv' AS two
  FROM part JOIN asked ON query_id = p_partkey),
fits AS (SELECT r.query_id, e.path, e.rank FROM expanded e JOIN replied r USING (query_id) JOIN cs USING (chunk_id) WHERE answer <> '' AND {HOLDS("cs.text", "answer")} AND len(list_intersect(terms, {FILE_TERMS.format("cs.text")})) >= CASE WHEN len(terms) <= 3 THEN 1 ELSE 2 END),
shown AS (SELECT query_id, path, min(rank) AS rank, true AS shown FROM fits GROUP BY ALL),
texts AS MATERIALIZED (SELECT path, bool_or(superseded) AS superseded, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM cs GROUP BY path),
retrieved AS (SELECT query_id, path, min(rank) AS rank FROM expanded ANTI JOIN shown USING (query_id) GROUP BY ALL),
whole AS (SELECT query_id, path, rank, false AS shown FROM retrieved JOIN texts USING (path) JOIN replied USING (query_id) WHERE answer <> '' AND {HOLDS("texts.text", "answer")} AND len(list_intersect(terms, {FILE_TERMS.format("texts.text")})) >= CASE WHEN len(terms) <= 3 THEN 1 ELSE 2 END),
cited AS (SELECT query_id, one AS path, 0 AS pos FROM replied UNION ALL SELECT query_id, two, 1 FROM replied),
held AS (
  SELECT s.*, pos, superseded, bool_or(pos IS NOT NULL) OVER (PARTITION BY query_id) AS any_cited, min(rank) OVER (PARTITION BY query_id) AS first
  FROM (SELECT * FROM shown UNION ALL SELECT * FROM whole) s LEFT JOIN cited USING (query_id, path) JOIN texts USING (path)),
picked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, path) AS k FROM held WHERE CASE WHEN any_cited THEN pos IS NOT NULL ELSE rank = first END),
value AS MATERIALIZED (SELECT * FROM (SELECT query_id, path, coalesce(pos, 0) AS pos, superseded, shown, bool_or(NOT superseded) OVER (PARTITION BY query_id) AS current FROM picked WHERE any_cited OR k = 1) WHERE NOT current OR NOT superseded),
pairs AS (SELECT DISTINCT ident, path FROM ids JOIN few USING (ident)),
keys AS (SELECT DISTINCT query_id, ident FROM value JOIN pairs USING (path) JOIN replied USING (query_id) WHERE NOT contains({GRADED.format("question")}, ident)),
links AS (SELECT DISTINCT c.query_id, c.path, c.pos FROM cited c ANTI JOIN value v USING (query_id, path) JOIN texts USING (path) JOIN pairs USING (path) SEMI JOIN keys USING (query_id, ident) WHERE NOT superseded),
grounds AS (
  SELECT query_id, string_agg(path, ',' ORDER BY part, pos, path) AS citations, bool_or(superseded) AS old, bool_or(shown) AS shown
  FROM (SELECT query_id, path, pos, superseded, shown, 0 AS part FROM value UNION ALL SELECT query_id, path, pos, false, NULL, 1 FROM links) GROUP BY query_id),
judged AS (
  SELECT *, CASE WHEN answer = '' THEN 'empty answer' WHEN citations IS NULL THEN 'answer not found in any retrieved file' WHEN NOT shown AND {HOLDS("question", "answer")} THEN 'answer only echoes the question' ELSE 'grounded' END AS reason
  FROM replied LEFT JOIN grounds USING (query_id))"""

ORACLES: dict[str, str] = {
    "identifier_expand": f"WITH {EXPANDED} SELECT * FROM expanded",
    "contract_answers": f"""WITH {VERIFIED},
told AS (SELECT *, CASE WHEN query_id % 350 = 0 THEN 'no usable reply' WHEN query_id % 450 = 0 OR answer = '' THEN 'not answerable' ELSE reason END AS why FROM judged)
SELECT query_id, CASE WHEN why = 'grounded' THEN answer ELSE '' END AS answer, CASE WHEN why = 'grounded' THEN citations ELSE '' END AS citations,
  CASE WHEN why = 'grounded' THEN round(CASE WHEN shown THEN 0.9::DOUBLE ELSE 0.7 END - CASE WHEN old THEN 0.2 ELSE 0 END, 3) ELSE 0 END AS confidence, why AS reason FROM told""",
    "verify_and_cite": f"""WITH {VERIFIED}
SELECT query_id, CASE WHEN reason = 'grounded' THEN answer ELSE '' END AS answer, CASE WHEN reason = 'grounded' THEN citations ELSE '' END AS citations,
  CASE WHEN reason = 'grounded' THEN round(CASE WHEN shown THEN 0.9::DOUBLE ELSE 0.7 END - CASE WHEN old THEN 0.2 ELSE 0 END, 3) ELSE 0 END AS confidence, reason FROM judged""",
    "service_context": f"""WITH {_bm25(TOKENS, 'text', 1.5)},
top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 3),
c AS (SELECT query_id, string_agg('[' || chunk_id || '] (' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT query_id, length(context) AS n_chars, md5(context) AS context_md5 FROM c""",
    "file_prompts": f"""WITH {CONTRACT},
f AS (SELECT query_id, path, min(rank) AS first, string_agg('--' || CASE WHEN chunk_id % 2 = 0 THEN ' (doc ' || chunk_id || ')' ELSE '' END || chr(10) || text, chr(10) ORDER BY rank) AS parts FROM hits JOIN documents ON doc_id = chunk_id GROUP BY ALL),
b AS (SELECT query_id, string_agg('[FILE ' || path || ' | ' || CASE WHEN path = 'src3' THEN 'superseded by src4' WHEN path IN ('src0', 'src7') THEN 'superseded' ELSE 'current' END || ']' || chr(10) || parts, chr(10) || chr(10) ORDER BY first) AS blocks FROM f GROUP BY query_id),
p AS (SELECT query_id, 'Question: ' || text || chr(10) || chr(10) || 'Excerpts:' || chr(10) || chr(10) || blocks AS prompt FROM b JOIN benchmark ON item_id = query_id)
SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
    "reply_extract": "SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "answer_outcomes": f"""WITH {ANSWERS}
SELECT query_id, outcome, CASE WHEN e IS NULL THEN coalesce(n, 0) ELSE 0 END AS n_claims, CASE WHEN e IS NULL THEN round(coalesce(r, 1), 4) END AS unsupported_ratio, CASE WHEN e IS NULL THEN round(coalesce(1 - r, 1), 4) END AS faithfulness,
  CASE WHEN e IS NULL THEN round(coalesce(gr, 0), 4) END AS grounded_ratio, md5(CASE WHEN outcome = 'answered' THEN a ELSE '' END) AS answer_md5,
  CASE WHEN outcome = 'model_abstained' THEN CASE WHEN query_id % 14 = 2 THEN 'not in the text' ELSE 'the model declined' END END AS said FROM outcomes""",
    "outcome_counts": f"""WITH {ANSWERS}
SELECT 'queries' AS counter, CASE WHEN outcome = 'answered' THEN outcome ELSE 'abstained' END AS label, count(*) AS n FROM outcomes GROUP BY ALL
UNION ALL SELECT 'abstentions', outcome, count(*) FROM outcomes WHERE outcome <> 'answered' GROUP BY ALL""",
    "bench_summary": """WITH e AS (SELECT value, event_id % 20 <> 0 AS ok, event_id % 300 AS t FROM events WHERE value IS NOT NULL),
r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM e WHERE ok),
p AS (SELECT round(max(value) FILTER (i = round_even(0.5::DOUBLE * (n - 1), 0) + 1), 2) AS p50_ms, round(max(value) FILTER (i = round_even(0.95::DOUBLE * (n - 1), 0) + 1), 2) AS p95_ms, round(max(value) FILTER (i = round_even(0.99::DOUBLE * (n - 1), 0) + 1), 2) AS p99_ms FROM r)
SELECT (SELECT count(*) FROM e) AS requests, p50_ms, p95_ms, p99_ms, round((SELECT avg(value) FROM e WHERE ok), 2) AS mean_ms, round((SELECT count(*) FROM e WHERE ok) / 50.0::DOUBLE, 3) AS throughput_req_s,
  CAST((SELECT sum(t) FROM e WHERE ok) AS BIGINT) AS total_tokens, round((SELECT sum(t) FROM e WHERE ok) / 50.0::DOUBLE, 2) AS tokens_per_s, round((SELECT count(*) FROM e WHERE NOT ok)::DOUBLE / (SELECT count(*) FROM e), 4) AS error_rate,
  round(1000 * (1.99::DOUBLE / 3600) * 50.0::DOUBLE / (SELECT count(*) FROM e WHERE ok), 4) AS cost_per_1k_queries_usd FROM p""",
    "report_lines": f"""WITH {CASES}, m AS (SELECT prompt_version, count(*) AS n, round(count(*) FILTER (correct) / count(*), 4) AS a, round(coalesce(avg(faithfulness) FILTER (NOT abstained), 1), 4) AS f, round(coalesce(avg(grounded_ratio) FILTER (NOT abstained), 0), 4) AS g,
  round(coalesce(count(*) FILTER (abstained AND expects_abstain) / nullif(count(*) FILTER (expects_abstain), 0), 1), 4) AS ar, round(coalesce(count(*) FILTER (abstained AND expects_abstain) / nullif(count(*) FILTER (abstained), 0), 1), 4) AS ap,
  round(avg(latency_ms), 2) AS l, CAST(sum(tokens) AS BIGINT) AS t FROM decided GROUP BY prompt_version)
SELECT prompt_version, '| ' || concat_ws(' | ', prompt_version, n, round(100 * a, 1) || '%', round(100 * f, 1) || '%', round(100 * g, 1) || '%', round(100 * ar, 1) || '%', round(100 * ap, 1) || '%', round(l, 1) || ' ms', format('{{:,}}', t)) || ' |' AS line FROM m""",

    "tokenize_counts": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "content_terms": f"SELECT doc_id, len(t) AS n_terms, md5(coalesce(list_aggregate(list_sort(t), 'string_agg', ' '), '')) AS terms_md5 FROM (SELECT doc_id, {TERMS.format('text')} AS t FROM documents)",
    "sentence_split": f"SELECT doc_id, len(s) AS n_sentences, md5(coalesce(list_aggregate(s, 'string_agg', '|'), '')) AS sentences_md5 FROM (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents)",
    "contract_tokenize": f"SELECT doc_id, len(t) AS n_tokens, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {FILE_TOKENS.format('text')} AS t FROM documents)",
    "plural_stem": f"SELECT {STEM.format('token')} AS stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_forms FROM (SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1) GROUP BY 1",
    "grader_normalize": f"SELECT doc_id, length(g) AS n_chars_graded, md5(g) AS graded_md5 FROM (SELECT doc_id, {GRADED.format('text')} AS g FROM documents)",
    "normalized_contains": f"SELECT page_id, {GRADED.format(HOST)} <> '' AND contains({GRADED.format('html')}, {GRADED.format(HOST)}) AS holds_host, {GRADED.format(HOST)} <> '' AND contains({GRADED.format('url')}, {GRADED.format(HOST)}) AS holds_in_url FROM pages",
    "identifier_extract": f"SELECT doc_id, len(i) AS n_identifiers, md5(coalesce(list_aggregate(list_sort(i), 'string_agg', ','), '')) AS identifiers_md5 FROM (SELECT doc_id, {IDENTIFIERS.format('text')} AS i FROM documents)",
    "strip_unit": f"SELECT p_partkey, {STRIP.format('r')} AS bare FROM (SELECT p_partkey, p_size || (['', ' V', '%', ' ms', ' seconds', 'kHz', ' GB', ' boxes', '-B2', ' degrees C'])[p_partkey % 10 + 1] AS r FROM part)",
    # The second line of a raw answer never counts; white space of every kind is taken off by a class of its own.
    "clean_answer": f"""SELECT p_partkey, {STRIP.format("regexp_replace(regexp_replace(line, '^[" + QUOTES + "]+|[" + QUOTES + ".;,]+$', '', 'g'), '(?i)^(?:answer|value)\\s*[:=]\\s*', '')")} AS answer FROM (
  SELECT p_partkey, rtrim(string_split(ltrim(raw, chr(10) || chr(9) || ' '), chr(10))[1], chr(9) || ' ') AS line FROM (
    SELECT p_partkey, CASE WHEN p_partkey % 12 = 5 THEN chr(10) || chr(9) || p_size || ' V' || chr(10) WHEN p_partkey % 4 = 0 THEN '"Answer: ' || p_size || ' V". ' WHEN p_partkey % 4 = 1 THEN 'value = ''' || p_name || '''' WHEN p_partkey % 4 = 2 THEN p_brand || '.;' || chr(10) || 'more' ELSE ' `' || p_size || '%`' END AS raw FROM part))""",
    "citation_labels": "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id AS VARCHAR) WHEN turn % 2 = 0 THEN role || ' §' || turn ELSE role END AS label FROM conversations",
    "reply_parse": "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 3 <> 0 AND event_id % 7 = 0 OR props IS NULL AS unparseable FROM events",
    "family_revision": f"WITH {FILES}, {REVISED} SELECT page_id, path, family, list_aggregate(list_transform(revision, lambda x: CAST(x AS VARCHAR)), 'string_agg', '.') AS revision, withdrawn FROM keyed",
    "superseded": f"""WITH {FILES.replace("SELECT page_id, page_id % 13 <> 0 AS indexed,", "SELECT max(page_id % 13 <> 0) AS indexed,").replace("FROM pages)", "FROM pages GROUP BY path)")}, {REVISED},
newest AS (SELECT family, path AS newest, revision AS r FROM keyed WHERE indexed AND NOT withdrawn QUALIFY row_number() OVER (PARTITION BY family ORDER BY revision DESC, {WALK_KEY.format('path')}) = 1)
SELECT path, indexed, CASE WHEN indexed AND path <> newest AND (withdrawn OR revision < r) THEN newest END AS superseded_by, withdrawn OR coalesce(indexed AND path <> newest AND (withdrawn OR revision < r), false) AS superseded FROM keyed LEFT JOIN newest USING (family)""",
    "walk_order": f"SELECT page_id, {WALK_KEY.format('p')} AS walk_key, len(list_intersect(string_split(p, '/'), [{_list(IGNORED)}])) = 0 AS walked FROM (SELECT page_id, {NO_SCHEME} AS p FROM pages)",
    "folder_fingerprints": f"SELECT regexp_extract(path, '^([^/]*)/', 1) AS folder, sha1(string_agg(path || ':' || size || chr(10), '' ORDER BY {WALK_KEY.format('path')})) AS fingerprint, count(*) AS n_files FROM (SELECT {NO_SCHEME} AS path, max(length(html)) AS size FROM pages GROUP BY 1) WHERE len(list_intersect(string_split(path, '/'), [{_list(IGNORED)}])) = 0 GROUP BY 1",
    "corpus_fingerprint": f"""WITH f AS (SELECT {NO_SCHEME} AS path, max(length(html)) AS size FROM pages GROUP BY 1),
s AS (SELECT substring(md5(path), 1, 3) AS share, sha1(string_agg(path || ':' || size || chr(10), '' ORDER BY {WALK_KEY.format('path')})) AS digest, count(*) AS n FROM f WHERE len(list_intersect(string_split(path, '/'), [{_list(IGNORED)}])) = 0 GROUP BY 1)
SELECT sha1(string_agg(digest, '' ORDER BY share)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_files FROM s""",
    "detect_kind": f"SELECT page_id, CASE {_kind()} WHEN html LIKE '\\%PDF-%' ESCAPE '\\' THEN 'pdf' END AS kind FROM (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS bare FROM pages)",
    "withdrawn_flag": r"SELECT doc_id, regexp_matches(substring(CASE WHEN doc_id % 5 = 0 THEN 'Do not use! ' ELSE '' END || text, 1, 2000), '(?i)\b(withdrawn|superseded|obsolete|do not use)\b') AS withdrawn FROM documents",
    "row_segments": " UNION ALL ".join([_row("part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), _row("supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), _row("customer", "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])]),
    "identifier_files_cap12": f"""SELECT ident, string_agg(path, ',' ORDER BY path) AS files, count(*) AS n_files FROM (
  SELECT DISTINCT path, unnest({IDENTIFIERS.format('text')}) AS ident FROM (
    SELECT 'cust/' || (o_custkey % 500) || '.csv' AS path, 'ORD-' || o_orderkey || ' CLK-' || (o_custkey % 300) || '-Q ' || (o_orderkey % 9) || ' KEY-' || (o_orderkey % 50) AS text FROM orders)) GROUP BY ident HAVING count(*) <= 12""",
    "resolve_paths": f"""WITH p AS (SELECT page_id, {NO_SCHEME} AS p FROM pages), files AS (SELECT DISTINCT p AS path FROM p),
a AS (SELECT page_id AS query_id, CASE WHEN page_id % 15 = 10 THEN replace(p, '/', '%2F') WHEN page_id % 5 = 0 THEN '/app/corpus/' || p WHEN page_id % 5 = 1 THEN upper(p) WHEN page_id % 5 = 2 THEN '`' || p || '`' WHEN page_id % 5 = 3 THEN regexp_extract(p, '([^/]*)$', 1) ELSE 'missing/' || p || '.x' END AS raw FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(trim(replace(raw, '%2F', '/')), '^[`''" ]+|[`''" ]+$', '', 'g'), '\\', '/'), '^(?:/?app/)?(?:corpus/)?(?:\\./)?', ''), '^/+', '') AS cand FROM a),
lowered AS (SELECT lower(path) AS low, max(path) AS path FROM files GROUP BY 1),
named AS (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS name, min(path) AS path FROM files GROUP BY 1 HAVING count(*) = 1)
SELECT query_id, raw, coalesce(f.path, l.path, n.path) AS path FROM c LEFT JOIN files f ON f.path = cand LEFT JOIN lowered l ON l.low = lower(cand) LEFT JOIN named n ON n.name = lower(regexp_extract(cand, '([^/]*)$', 1))""",
    "transcript_reuse": "SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 4 = 0 AND trim(html) <> '' THEN 'seen before: ' || html ELSE html END AS text, page_id % 4 = 0 AND trim(html) <> '' AS reused FROM pages",
    "section_split": rf"""WITH {MARKDOWN},
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM md)),
f AS (SELECT doc_id, i, ls[i + 1] AS line, regexp_matches(ls[i + 1], '^(#{{1,6}})\s+(.*)$') AS head FROM l),
n AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM f),
s AS (SELECT doc_id, CAST(no AS BIGINT) AS section_no, coalesce(max(trim(regexp_extract(line, '^(#{{1,6}})\s+(.*)$', 2))) FILTER (head), '') AS heading,
  regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), ''), '^\s+|\s+$', '', 'g') AS body FROM n GROUP BY 1, 2)
SELECT doc_id, section_no, heading, length(body) AS n_chars, md5(body) AS body_md5 FROM s WHERE body <> ''""",
    "line_chunks": r"""WITH RECURSIVE l AS (SELECT doc_id, coalesce(source, '') AS locator, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS ls FROM documents),
n AS (SELECT doc_id, locator, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS x FROM l),
w AS (SELECT *, regexp_extract_all(x, '\S+') AS ws FROM n),
p AS (SELECT doc_id, locator, line, 0 AS k, x, len(ws) AS n FROM w WHERE len(ws) <= 170
  UNION ALL SELECT doc_id, locator, line, k, array_to_string(ws[k * 170 + 1:k * 170 + 170], ' '), len(ws[k * 170 + 1:k * 170 + 170]) FROM (SELECT *, unnest(range((len(ws) + 169) // 170)) AS k FROM w WHERE len(ws) > 170)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) AS i FROM p),
f AS (SELECT doc_id, i, 0 AS g, n AS size, n AS last FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, CASE WHEN f.size + o.n > 170 THEN f.g + 1 ELSE f.g END, CASE WHEN f.size + o.n > 170 THEN f.last + o.n ELSE f.size + o.n END, o.n FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1),
m AS (SELECT doc_id, g, i FROM f UNION ALL SELECT f.doc_id, f.g, f.i - 1 FROM f JOIN f b ON b.doc_id = f.doc_id AND b.i = f.i - 1 AND b.g = f.g - 1),
s AS (SELECT doc_id, g, any_value(locator) AS locator, min(line) AS a, max(line) AS z, string_agg(x, chr(10) ORDER BY i) AS text FROM m JOIN o USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, CAST(g AS INTEGER) AS piece_no, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN trim(locator || ' lines ' || a || '-' || z) ELSE locator END AS locator, text FROM s""",
    "term_freq": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({TOKENS.format('text')})), 6) AS avgdl FROM documents",
    "bm25_batch": f"WITH {_bm25(TOKENS, 'text', 1.5)} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM scored QUALIFY rank <= 10",
    "contract_search": f"""WITH {_bm25(FILE_TOKENS, "source || chr(10) || text", 1.4)},
raw AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM scored QUALIFY r <= 60),
adj AS (SELECT query_id, chunk_id, source AS path, r, CASE WHEN source IN ('src0', 'src3', 'src7') THEN score * 0.4 ELSE score END AS score FROM raw JOIN documents ON doc_id = chunk_id),
cap AS (SELECT * FROM adj QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY round(score, 9) DESC, r) <= 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank, chunk_id, path, round(score, 6) AS score FROM cap QUALIFY rank <= 10""",
    "dense_topk": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS s FROM v JOIN v q ON q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank, chunk_id, round(s, 6) AS score FROM s WHERE s > 0 QUALIFY rank <= 10""",
    "hash_embed_md5": f"WITH {_vectors('qv', 'benchmark', 'item_id')} SELECT id AS query_id, b AS bucket, round(x, 6) AS value FROM qv",
    "hybrid_search": HYBRID + " SELECT query_id, fused_rank, chunk_id, lexical_rank, dense_rank, fused_score FROM hybrid",
    "rerank_select": HYBRID
    + f""", jac AS (
  SELECT h.*, round(CASE WHEN len(u) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(u) END, 4) AS rerank_score
  FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT hybrid.*, list_distinct({TOKENS.format("d.text")}) AS a, list_distinct({TOKENS.format("q.text")}) AS b FROM hybrid JOIN documents d ON d.doc_id = chunk_id JOIN benchmark q ON q.item_id = query_id)) h),
kept AS (SELECT * FROM (SELECT *, max(fused_score >= 0.02) OVER (PARTITION BY query_id) AS any_ok FROM jac) WHERE fused_score >= 0.02 OR NOT any_ok)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS final_rank, chunk_id, rerank_score FROM kept QUALIFY final_rank <= 4""",
    "index_roundtrip": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "index_summary": "SELECT count(DISTINCT source) AS files, count(DISTINCT CASE WHEN regexp_matches(text, '\\S') THEN source END) AS indexed, count(*) AS chunks FROM documents",
    "ingest_replaces": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS.format("CASE WHEN doc_id % 7 = 0 THEN 'replaced ' || regexp_replace(text, '[aeiou]', '', 'g') ELSE text END")}) AS term FROM documents) GROUP BY 1",
    "claim_coverage": f"WITH {CLAIMS} SELECT claim_id, n_cited, n_resolved, coverage_score, supported, best_chunk_id, status FROM stated",
    "supporting_quote": f"""WITH {CLAIMS},
cand AS (SELECT claim_id, best_chunk_id, best_text, text, ss, CASE WHEN len(ss) > 0 THEN unnest(range(len(ss))) END AS i FROM (SELECT *, {SENTENCES.format("best_text")} AS ss FROM stated WHERE best_chunk_id IS NOT NULL))
SELECT claim_id, best_chunk_id, coalesce(ss[i + 1], substring(best_text, 1, 200)) AS quote FROM cand
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY len(list_intersect({TERMS.format("text")}, {TERMS.format("ss[i + 1]")})) DESC, i) = 1""",
    "answer_gate": f"""WITH {CLAIMS},
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (status IN ('unsupported', 'uncited')) / count(*) AS r, count(*) FILTER (status = 'supported') / count(*) AS gr, coalesce(string_agg(text, ' ' ORDER BY turn, pos) FILTER (status IN ('supported', 'ungrounded')), '') AS a FROM stated GROUP BY query_id)
SELECT query_id, n AS n_claims, round(r, 4) AS unsupported_ratio, r > 0.2 AS abstained, round(1 - r, 4) AS faithfulness, round(gr, 4) AS grounded_ratio, md5(CASE WHEN r > 0.2 THEN '' ELSE a END) AS answer_md5 FROM g""",
    "outcome_counters": f"WITH {CLAIMS} SELECT status, count(*) AS n_claims FROM stated GROUP BY status",
    "number_mentions": f"WITH {MENTIONS}, x AS (SELECT query_id, ord, source, value, c, unnest(range(len(c))) AS k FROM mentions), y AS (SELECT query_id, ord, source, value, c[k + 1] AS w, min(k) AS k FROM x GROUP BY ALL) SELECT query_id, ord, source, value, string_agg(w, ' ' ORDER BY k) AS ctx FROM y GROUP BY ALL",
    "conflicts": f"""WITH {MENTIONS}, m AS (SELECT query_id, ord, source, value, list_distinct(c) AS c FROM mentions),
p AS (
  SELECT a.query_id, a.ord AS oa, b.ord AS ob, a.source AS source_a, a.value AS value_a, b.source AS source_b, b.value AS value_b, list_sort(list_intersect(a.c, b.c)) AS s
  FROM m a JOIN m b ON a.query_id = b.query_id AND a.ord < b.ord AND a.source <> b.source AND a.value <> b.value)
SELECT query_id, source_a, value_a, source_b, value_b, list_aggregate(s, 'string_agg', ' / ') AS claim_text FROM p WHERE len(s) >= 2
QUALIFY row_number() OVER (PARTITION BY query_id, least(source_a || ':' || value_a, source_b || ':' || value_b), greatest(source_a || ':' || value_a, source_b || ':' || value_b) ORDER BY oa, ob) = 1""",
    "score_cases": f"WITH {CASES} SELECT doc_id, prompt_version, correct FROM decided",
    "ablation_report": f"""WITH {CASES} SELECT prompt_version, count(*) AS n_cases, round(count(*) FILTER (correct) / count(*), 4) AS accuracy,
  round(coalesce(avg(faithfulness) FILTER (NOT abstained), 1), 4) AS mean_faithfulness, round(coalesce(avg(grounded_ratio) FILTER (NOT abstained), 0), 4) AS mean_grounded_ratio,
  round(coalesce(count(*) FILTER (abstained AND expects_abstain) / nullif(count(*) FILTER (expects_abstain), 0), 1), 4) AS abstention_recall,
  round(coalesce(count(*) FILTER (abstained AND expects_abstain) / nullif(count(*) FILTER (abstained), 0), 1), 4) AS abstention_precision,
  round(avg(latency_ms), 2) AS mean_latency_ms, CAST(sum(tokens) AS BIGINT) AS total_tokens FROM decided GROUP BY prompt_version""",
    "grading_points": """SELECT p_partkey, CAST(CASE WHEN upper(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE regexp_replace(p_brand, '#', ' - ', 'g') END, '[\\s\\-._]+', '', 'g')) = upper(regexp_replace(regexp_replace(p_brand, '#', '', 'g'), '[\\s\\-._]+', '', 'g'))
  AND (p_partkey % 2 = 0) = (p_partkey % 4 < 2) THEN 20 ELSE 0 END AS BIGINT) AS points FROM part""",
    "percentile_nearest_rank": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, share, value FROM r JOIN (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS share) ON i = round_even(share * (n - 1), 0) + 1""",
    "cost_accounting": f"""SELECT conv_id, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, round((p + c)::DOUBLE / 900 * (1.99::DOUBLE / 3600), 9) AS cost_usd FROM (
  SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN len({TOKENS.format('text')}) ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN role <> 'user' THEN len({TOKENS.format('text')}) ELSE 0 END) AS BIGINT) AS c FROM conversations GROUP BY conv_id)""",
}
