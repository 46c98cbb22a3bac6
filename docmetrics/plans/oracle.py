"""DuckDB SQL for every registered query (the correctness oracle).

Each statement recomputes its query from the raw views with plain SQL
(window functions, recursive CTEs for the greedy chunkers), independent of
the Spark operators. Fixed values (patterns, catalogue rows, fixture texts)
are rendered from the same constants the library uses.
"""

from __future__ import annotations

import re

from docmetrics.catalog import CATEGORY_LABELS, CORPUS_CATALOG, ESG_CATALOG
from docmetrics.functions.text import CHUNK_LIMIT, SECTION_HEAD, TABLE_LINE, TABLE_SEPARATOR
from docmetrics.operators.embed import DEFAULT_DIM, QUERY_TEMPLATE
from docmetrics.operators.extract import PLAIN_TEMPLATE, PROMPT_TEMPLATE
from docmetrics.plans.queries import CANDIDATE_KEYWORDS, EVENT_METRIC
from docmetrics.sources.documents import SERVICE_FORMATS, TEXT_FORMATS
from docmetrics.sources.fixtures import REPORTS

ALL_CATALOG = ESG_CATALOG + CORPUS_CATALOG
NL = "chr(10)"
# Python's str.split() separators, as an RE2 class.
PY_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _num(v) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({float(v)!r} AS DOUBLE)"


def catalog_values(catalog) -> str:
    rows = []
    cats: dict[str, int] = {}
    per: dict[str, int] = {}
    for m in catalog:
        c = cats.setdefault(m.category, len(cats) + 1)
        per[m.category] = per.get(m.category, 0) + 1
        srcs = "[" + ", ".join(q(s) for s in m.possible_sources) + "]"
        rows.append(f"({c}, {per[m.category]}, {q(m.category)}, {q(m.metric_id)}, {q(m.name)}, "
                    f"{q(m.code)}, {q(m.unit)}, {q(m.type)}, {srcs}, {_num(m.vmin)}, {_num(m.vmax)}, "
                    f"{_num(m.recommended_min)}, {q(m.trend) if m.trend else 'NULL'})")
    return ("(SELECT * FROM (VALUES " + ", ".join(rows) + ") t(cat_ord, metric_ord, category, "
            "metric_id, name, code, unit, type, possible_sources, vmin, vmax, recommended_min, trend))")


ESG = catalog_values(ESG_CATALOG)
ALLCAT = catalog_values(ALL_CATALOG)


# The value grammar, written from its rule: sign inside brackets, bracketed number, plain number, upper end of a range,
# scale word; then the unit. Brackets mean a negative value (unless they hold a plus), and so does a dash that
# stands right before the number and not after a letter, digit or dash.
NUM = "[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?"
UNITS = "公噸CO2e|立方米|百分比|小時|分鐘|%|％|個|人|元"


def quantity(num: str) -> str:
    return f"(?:[(（][ \\t]*([-−－+]?)[ \\t]*({num})[ \\t]*[)）]|({num}))(?:[ \\t]*[~～〜–至][ \\t]*({num}))?[ \\t]*(萬|億)?"


def unit_norm(u: str) -> str:
    return f"(CASE WHEN {u} IN ('％', '百分比') THEN '%' ELSE {u} END)"


def value_norm(raw: str, scale: str, negative: str) -> str:
    return (f"CAST(TRY_CAST(replace({raw}, ',', '') AS DECIMAL(28,6)) * CAST((CASE {scale} WHEN '萬' THEN 10000 WHEN '億' THEN 100000000 ELSE 1 END) "
            f"* (CASE WHEN {negative} THEN -1 ELSE 1 END) AS DECIMAL(10,0)) AS DECIMAL(38,6))")


def candidates(name: str, keywords) -> str:
    """``{name}``: the candidates of the keywords in ``chunks``."""
    rows = ", ".join(f"({q(kw)}, {q('(?i:' + re.escape(kw) + ')[^。' + chr(10) + ']*?' + quantity(NUM) + '[ \\t]*(?:' + UNITS + ')?')})"
                     for kw in dict.fromkeys(keywords))
    parts = f"^([^。\n]*?){quantity(NUM)}[ \\t]*({UNITS})?$"
    part = lambda i: f"regexp_extract(rest, {q(parts)}, {i})"
    return f"""
{name}0 AS (
  SELECT c.document_id, c.chunk_index, c.source_kind, k.keyword,
         CASE WHEN contains(lower(c.text), lower(k.keyword)) THEN regexp_extract_all(c.text, k.pat, 0) ELSE [] END AS ctx
  FROM chunks c CROSS JOIN (VALUES {rows}) k(keyword, pat)),
{name}1 AS (
  SELECT document_id, chunk_index, source_kind, keyword, CAST(generate_subscripts(ctx, 1) - 1 AS INTEGER) AS ordinal,
         unnest(ctx) AS context FROM {name}0),
{name}2 AS (SELECT *, substr(context, length(keyword) + 1) AS rest FROM {name}1),
{name}3 AS (SELECT *, {part(1)} AS before, {part(2)} AS inner_sign, {part(3)} AS bracketed, {part(4)} AS plain,
                   nullif({part(5)}, '') AS high_raw, nullif({part(6)}, '') AS scale, nullif({part(7)}, '') AS unit FROM {name}2),
{name}4 AS (SELECT *, bracketed = '' AND regexp_matches(before, '[^\\p{{L}}\\p{{N}}\\-−－][-−－]$') AS dash FROM {name}3),
{name} AS (
  SELECT document_id, chunk_index, source_kind, keyword, ordinal, context, CAST(length(before) - CAST(dash AS INTEGER) AS INTEGER) AS gap,
         bracketed || plain AS value_raw, dash OR (bracketed <> '' AND inner_sign <> '+') AS negative, high_raw, scale, unit FROM {name}4)"""


# --- corpus, elements, tables --------------------------------------------------------------

CORPUS = ("corpus AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text, source, lang FROM documents "
          "UNION ALL SELECT * FROM (VALUES "
          + ", ".join(f"({q(d)}, {q(t)}, 'fixture', 'zh')" for d, _, _, t in REPORTS)
          + ") f(document_id, text, source, lang))")

ELEMENTS = f"""
c_lines AS (
  SELECT document_id, line, line_no,
         CASE WHEN regexp_matches(line, {q(TABLE_LINE)}) THEN 'table'
              WHEN regexp_matches(line, {q('^' + PY_WS + '*$')}) THEN 'blank' ELSE 'text' END AS kind
  FROM (SELECT document_id, unnest(string_split(text, {NL})) AS line,
               generate_subscripts(string_split(text, {NL}), 1) AS line_no FROM corpus)),
c_starts AS (
  SELECT *, CASE WHEN kind = 'table' THEN before <> 'table' ELSE coalesce(last_kind, '') <> 'text' END AS s
  FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY document_id ORDER BY line_no), '') AS before,
               last_value(nullif(kind, 'blank') IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_kind FROM c_lines)),
c_numbered AS (
  SELECT *, sum(CAST(s AS INTEGER)) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) - 1 AS element_index
  FROM c_starts WHERE kind <> 'blank'),
elements AS (
  SELECT document_id, CAST(element_index AS INTEGER) AS element_index, any_value(kind) AS kind,
         string_agg(line, {NL} ORDER BY line_no) AS text
  FROM c_numbered GROUP BY document_id, element_index)"""


def cells(x: str) -> str:
    return (f"list_transform(string_split(regexp_replace({x}, '^[ \\t]*\\|?|\\|?[ \\t]*$', '', 'g'), '|'), "
            f"lambda c: trim(c))")


TABLES = f"""
p_tables AS (
  SELECT document_id, element_index, text, string_split(text, {NL}) AS lines,
         CAST(row_number() OVER (PARTITION BY document_id ORDER BY element_index) AS INTEGER) AS table_no
  FROM elements
  WHERE kind = 'table' AND len(string_split(text, {NL})) >= 2
    AND regexp_matches(string_split(text, {NL})[2], {q(TABLE_SEPARATOR)})),
v_tables AS (
  SELECT document_id, table_no,
         {NL} || '表格 ' || CAST(table_no AS VARCHAR) || ':' || {NL} || '欄位: '
         || array_to_string({cells('lines[1]')}, ', ') || {NL}
         || array_to_string(list_transform(list_concat([lines[1]], lines[3:]),
                                           lambda r: array_to_string({cells('r')}, ' ')), {NL})
         || {NL} AS text
  FROM p_tables)"""


def chunk_ctes(name: str, src: str, keys: list[str], limit: int = CHUNK_LIMIT) -> str:
    """Greedy word chunker as a recursive CTE over ``src`` (keys..., text).

    Produces ``{name}`` (keys..., ci, text) with ci from 0.
    """
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    kc = ", ".join(f"ch.{c}" for c in keys)
    return f"""
{name}_w AS (
  SELECT {k}, i, word, sum(length(word) + 1) OVER (PARTITION BY {k} ORDER BY i) AS p
  FROM (SELECT {k}, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
        FROM (SELECT {k}, list_filter(regexp_split_to_array(text, {q(PY_WS + '+')}), lambda x: x <> '') AS ws
              FROM {src}))),
{name}_r({k}, ci, s, e) AS (
  SELECT {k}, 0, 1::BIGINT, greatest(1, max(i) FILTER (WHERE p <= {limit}))::BIGINT FROM {name}_w GROUP BY {k}
  UNION ALL
  SELECT {kc}, ch.ci + 1, ch.e + 1,
         greatest(ch.e + 1, max(w.i) FILTER (WHERE w.p - b.p <= {limit + 1}))::BIGINT
  FROM {name}_r ch JOIN {name}_w b ON {on('b', 'ch')} AND b.i = ch.e
       JOIN {name}_w w ON {on('w', 'ch')} AND w.i > ch.e
  GROUP BY {kc}, ch.ci, ch.e),
{name} AS (
  SELECT {", ".join(f"r.{c}" for c in keys)}, r.ci, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM {name}_r r JOIN {name}_w w ON {on('w', 'r')} AND w.i BETWEEN r.s AND r.e
  GROUP BY {", ".join(f"r.{c}" for c in keys)}, r.ci)"""


CHUNKS = (
    chunk_ctes("tx", "(SELECT document_id, element_index, text FROM elements WHERE kind = 'text')",
               ["document_id", "element_index"])
    + ","
    + chunk_ctes("tb", "(SELECT document_id, string_agg(text, '' ORDER BY table_no) AS text "
                       "FROM v_tables GROUP BY document_id)", ["document_id"])
    + f""",
tx_n AS (SELECT document_id, count(*) AS n FROM tx GROUP BY document_id),
n_tables AS (SELECT document_id, count(*) AS n FROM p_tables GROUP BY document_id),
chunks0 AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY element_index, ci) - 1 AS chunk_index,
         'text' AS source_kind, text FROM tx
  UNION ALL
  SELECT tb.document_id, coalesce(tx_n.n, 0) + tb.ci, 'table', tb.text
  FROM tb LEFT JOIN tx_n USING (document_id)),
chunks AS (
  SELECT c.document_id, CAST(c.chunk_index AS INTEGER) AS chunk_index, c.source_kind, c.text,
         CAST(count(*) OVER (PARTITION BY c.document_id) AS INTEGER) AS total_chunks,
         CAST(coalesce(nt.n, 0) AS INTEGER) AS tables_found, d.source, d.lang
  FROM chunks0 c LEFT JOIN n_tables nt USING (document_id) JOIN corpus d USING (document_id))""")

# One report per user and block of 5,000 event ids: a heading and a pipe table of the events.
EVENT_REPORTS = f"""
corpus AS (SELECT 'u' || user_id || '-' || (event_id // 5000) AS document_id,
                  '# user ' || user_id || {NL} || {NL} || '| event | type | value |' || {NL} || '| --- | --- | --- |' || {NL}
                  || string_agg('| ' || event_id || ' | ' || event_type || ' | ' || printf('%.2f', value) || ' |', {NL} ORDER BY event_id) AS text,
                  'events' AS source, 'en' AS lang
           FROM events GROUP BY user_id, event_id // 5000)"""
CORPUS_CHUNKS = f"WITH RECURSIVE {CORPUS}, {ELEMENTS}, {TABLES}, {CHUNKS}"


# --- vectors -------------------------------------------------------------------------------

def terms_cte(name: str, src: str, keys: list[str], dim: int = DEFAULT_DIM) -> str:
    k = ", ".join(keys)
    return f"""
{name}_tok AS (
  SELECT {k}, unnest(list_filter(list_transform(string_split(text, ' '),
           lambda x: lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), lambda x: x <> '')) AS w
  FROM {src}),
{name}_t AS (
  SELECT {k}, 'w:' || w AS t FROM {name}_tok
  UNION ALL
  SELECT {k}, 'b:' || substr(w, i, 2) FROM (SELECT {k}, w, unnest(range(1, length(w))) AS i FROM {name}_tok)),
{name}_c AS (
  SELECT {k}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS bucket, count(*) AS tf
  FROM {name}_t GROUP BY ALL),
{name} AS (
  SELECT {k}, bucket, tf, CAST(sum(tf * tf) OVER (PARTITION BY {k}) AS BIGINT) AS norm2 FROM {name}_c)"""


def query_texts(catalog, with_bench: bool) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {q(m.metric_id)} AS query_id, {q(QUERY_TEMPLATE % m.name)} AS text" for m in catalog)
    if with_bench:
        rows += " UNION ALL SELECT 'bench-' || CAST(item_id AS VARCHAR), text FROM benchmark"
    return (f"qtext AS (SELECT query_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS text "
            f"FROM ({rows}))")


def sparse_hits(name: str, chunk_terms: str, query_terms: str, k: int, per_document: bool) -> str:
    part = "query_id, document_id" if per_document else "query_id"
    return f"""
{name}_s AS (
  SELECT q.query_id, c.document_id, c.chunk_index,
         CAST(sum(c.tf * q.tf) AS DOUBLE) / (sqrt(any_value(q.norm2)) * sqrt(any_value(c.norm2))) AS score
  FROM {chunk_terms} c JOIN {query_terms} q USING (bucket)
  GROUP BY q.query_id, c.document_id, c.chunk_index),
{name} AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part}
                    ORDER BY score DESC, document_id, chunk_index) AS INTEGER) AS rank FROM {name}_s)
  WHERE rank <= {k})"""


# --- answers -------------------------------------------------------------------------------

def _case(expr: str, mapping: dict) -> str:
    return "(CASE " + " ".join(f"WHEN {expr} = {q(a)} THEN {q(b)}" for a, b in mapping.items()) + " END)"


_UNITS = {m.metric_id: m.unit for m in ESG_CATALOG}
# A value that stands alone: about-sign, sign, quantity (a bare fraction counts too), unit.
VALUE_TEXT = "^[ \\t]*約?[ \\t]*([-−－+]?)[ \\t]*" + quantity(NUM + "|[0-9]*[.][0-9]+") + "[ \\t]*(.*?)[ \\t]*$"

ANSWERS = f"""
ev AS (
  SELECT event_id, user_id, value, {_case('event_type', EVENT_METRIC)} AS metric_id,
         printf('%.2f', value) AS v,
         printf('%.4f', least(value / 500.0, 1.0)) AS conf,
         (CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 34 THEN 'table'
               WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 67 THEN 'text' ELSE 'chart' END)
           || ':e' || CAST(event_id AS VARCHAR) AS src,
         CASE WHEN value < 100 THEN 'down' ELSE 'up' END AS trend
  FROM events),
ev2 AS (SELECT *, CASE event_id % 10 WHEN 8 THEN '-' || v WHEN 9 THEN v || '萬' ELSE v END || {_case('metric_id', _UNITS)} AS vtext FROM ev),
ev3 AS (SELECT *, '{{"value":"' || vtext || '","source":"' || src || '","confidence":' || conf || '}}' AS plain FROM ev2),
answers AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS document_id, event_id AS response_id, metric_id,
    CASE event_id % 10
      WHEN 0 THEN 'not json: ' || v
      WHEN 1 THEN '{{"value":"' || vtext || '"}}'
      WHEN 2 THEN '{{"value":null,"source":"' || src || '","confidence":' || conf || '}}'
      WHEN 3 THEN '{{"value":"' || vtext || '","source":"' || src || '","confidence":"' || conf
                  || '","trend":"' || trend || '"}}'
      WHEN 4 THEN '```json' || {NL} || plain || {NL} || '```'
      WHEN 5 THEN 'null'
      WHEN 6 THEN '{{"value":"","source":"' || src || '","confidence":' || conf || '}}'
      WHEN 7 THEN '{{"value":"' || vtext || '","source":"' || src || '","confidence":"high"}}'
      ELSE plain END AS response
  FROM ev3),
parsed0 AS (
  SELECT *, CASE WHEN json_valid(response) AND json_type(response) = 'OBJECT'
                 THEN json_keys(response) END AS keys
  FROM answers),
parsed AS (
  SELECT document_id, response_id, metric_id,
         CASE WHEN keys IS NOT NULL THEN json_extract_string(response, '$.value') END AS value,
         CASE WHEN keys IS NOT NULL THEN json_extract_string(response, '$.source') END AS source,
         CASE WHEN keys IS NOT NULL THEN TRY_CAST(json_extract_string(response, '$.confidence') AS DOUBLE) END AS confidence,
         coalesce(CASE WHEN keys IS NOT NULL THEN json_extract_string(response, '$.trend') END, '') AS trend,
         CASE WHEN keys IS NULL THEN 'not an object'
              WHEN NOT (list_contains(keys, 'value') AND list_contains(keys, 'source')
                        AND list_contains(keys, 'confidence')) THEN 'missing key' END AS reason
  FROM parsed0),
kept AS (SELECT * FROM parsed WHERE reason IS NULL),
res0 AS (
  SELECT k.document_id, k.response_id, c.name AS item, k.value, k.source, c.category, k.metric_id,
         k.confidence, k.trend,
         regexp_extract(k.value, '{VALUE_TEXT}', 1) AS sign_raw, regexp_extract(k.value, '{VALUE_TEXT}', 2) AS inner_sign,
         regexp_extract(k.value, '{VALUE_TEXT}', 3) AS bracketed, regexp_extract(k.value, '{VALUE_TEXT}', 4) AS plain,
         regexp_extract(k.value, '{VALUE_TEXT}', 6) AS scale_raw, nullif(regexp_extract(k.value, '{VALUE_TEXT}', 7), '') AS unit_raw,
         nullif(regexp_extract(k.source, '^([a-z]+):', 1), '') AS source_kind
  FROM kept k JOIN {ESG} c USING (metric_id)),
results AS (
  SELECT *, CAST({value_norm('(bracketed || plain)', 'scale_raw', "(sign_raw IN ('-', '−', '－') OR (bracketed <> '' AND inner_sign <> '+'))")} AS DOUBLE) AS value_num,
         {unit_norm('unit_raw')} AS unit FROM res0),
obs AS (
  SELECT r.*, c.vmin, c.vmax, c.recommended_min, c.type, c.possible_sources
  FROM results r JOIN {ESG} c USING (metric_id))"""

ANSWERS_WITH = f"WITH {ANSWERS}"

TRENDS = f"""
series AS (
  SELECT user_id, {_case('event_type', EVENT_METRIC)} AS metric_id, CAST(ts AS DATE) AS period, value FROM events),
per AS (SELECT user_id, metric_id, period, sum(value) AS value FROM series GROUP BY ALL),
trends AS (
  SELECT *, CASE WHEN prev_value IS NULL THEN NULL WHEN value - prev_value > 0 THEN 'increasing'
                 WHEN value - prev_value < 0 THEN 'decreasing' ELSE 'flat' END AS trend
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, metric_id ORDER BY period) AS prev_value FROM per))"""


def f4(x: str) -> str:
    return f"coalesce(printf('%.4f', {x}), '')"


VALIDATION_RULES = f"""
v_range AS (
  SELECT *, CASE WHEN value_num IS NULL THEN 'skip'
                 WHEN (vmin IS NULL OR value_num >= vmin) AND (vmax IS NULL OR value_num <= vmax) THEN 'pass'
                 ELSE 'fail' END AS status FROM obs),
v_rec AS (
  SELECT *, CASE WHEN value_num IS NULL OR recommended_min IS NULL THEN 'skip'
                 WHEN value_num < recommended_min THEN 'warning' ELSE 'ok' END AS severity FROM obs),
v_type AS (
  SELECT *, CASE WHEN coalesce(CASE WHEN type = 'percentage' THEN value_num IS NOT NULL AND unit = '%'
                                    WHEN type = 'numerical' THEN value_num IS NOT NULL ELSE true END, false)
                 THEN 'pass' ELSE 'fail' END AS status FROM obs),
v_src AS (
  SELECT *, array_to_string(possible_sources, ',') AS allowed,
         CASE WHEN source_kind IS NULL THEN 'skip' WHEN list_contains(possible_sources, source_kind) THEN 'pass'
              ELSE 'fail' END AS status FROM obs),
v_trend AS (
  SELECT t.*, c.trend AS declared, CASE WHEN t.trend = c.trend THEN 'pass' ELSE 'fail' END AS status
  FROM trends t JOIN {ESG} c USING (metric_id)
  WHERE c.trend IS NOT NULL AND t.trend IS NOT NULL)"""


# --- statements ----------------------------------------------------------------------------

def _sql() -> dict[str, str]:
    s: dict[str, str] = {}

    s["chunk_words"] = ("WITH RECURSIVE " + chunk_ctes("cw", "(SELECT doc_id, text FROM documents)", ["doc_id"])
                        + " SELECT doc_id, CAST(ci AS INTEGER) AS chunk_index, text FROM cw")

    s["chunk_words_blocks"] = s["chunk_words"]

    s["stream_chunks"] = ("WITH RECURSIVE " + chunk_ctes("cw", "(SELECT doc_id, text FROM documents)", ["doc_id"])
                          + " SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(ci AS INTEGER) AS chunk_index, text FROM cw")

    # Re-sent: every document once as it is, the German ones again with a word more, the French ones emptied.
    s["resent_chunks"] = ("WITH RECURSIVE " + chunk_ctes(
        "cw", "(SELECT doc_id, CASE lang WHEN 'de' THEN 'again ' || text WHEN 'fr' THEN '' ELSE text END AS text FROM documents)", ["doc_id"])
        + " SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(ci AS INTEGER) AS chunk_index, text FROM cw")

    # line chunker: heads break, overflow test len(cur) + len(line) > limit.
    lim = CHUNK_LIMIT
    s["chunk_lines"] = f"""
WITH RECURSIVE ln AS (
  SELECT doc_id, i, line, length(line) AS len,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS q,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS qp,
         regexp_matches(line, {q(SECTION_HEAD)}) AS h
  FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
               generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents)),
ch(doc_id, ci, s, e) AS (
  SELECT b.doc_id, 0, 1::BIGINT,
         (coalesce(min(w.i) FILTER (WHERE w.i > 1 AND ((w.h AND w.qp - (CASE WHEN b.len > {lim} THEN 1 ELSE 0 END) > 0)
                                     OR w.q > {lim + 1} + (CASE WHEN b.len > {lim} THEN 1 ELSE 0 END))),
                   max(w.i) + 1) - 1)::BIGINT
  FROM ln b JOIN ln w ON w.doc_id = b.doc_id WHERE b.i = 1 GROUP BY b.doc_id, b.len
  UNION ALL
  SELECT ch.doc_id, ch.ci + 1, ch.e + 1,
         (coalesce(min(w.i) FILTER (WHERE w.i > ch.e + 1 AND ((w.h AND w.qp - b.qp - 1 > 0) OR w.q - b.qp > {lim + 2})),
                   max(w.i) + 1) - 1)::BIGINT
  FROM ch JOIN ln b ON b.doc_id = ch.doc_id AND b.i = ch.e + 1
          JOIN ln w ON w.doc_id = ch.doc_id AND w.i > ch.e
  GROUP BY ch.doc_id, ch.ci, ch.e, b.qp),
txt AS (
  SELECT ch.doc_id, ch.ci,
         regexp_replace(string_agg(ln.line, {NL} ORDER BY ln.i), {q('^' + PY_WS + '+|' + PY_WS + '+$')}, '', 'g') AS text
  FROM ch JOIN ln ON ln.doc_id = ch.doc_id AND ln.i BETWEEN ch.s AND ch.e GROUP BY ch.doc_id, ch.ci)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ci) - 1 AS INTEGER) AS chunk_index, text
FROM txt WHERE text <> ''"""

    s["section_split"] = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no,
       CAST(sum(CASE WHEN regexp_matches(line, {q(SECTION_HEAD)}) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_no, line
FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
             generate_subscripts(string_split(text, {NL}), 1) AS i FROM documents)"""

    s["markdown_elements"] = f"WITH {CORPUS}, {ELEMENTS} SELECT document_id, element_index, kind, text FROM elements"

    both = f"{CORPUS.replace('corpus AS', 'corpus1 AS', 1)}, {EVENT_REPORTS.replace('corpus AS', 'corpus2 AS', 1)}, corpus AS (FROM corpus1 UNION ALL FROM corpus2)"
    s["table_cells"] = f"""
WITH {both}, {ELEMENTS}, {TABLES},
rws AS (
  SELECT document_id, table_no, {cells('lines[1]')} AS header,
         unnest(lines) AS line, generate_subscripts(lines, 1) AS lp
  FROM p_tables),
body AS (
  SELECT document_id, table_no, header, CAST(lp - 2 AS INTEGER) AS row_no, {cells('line')} AS cells
  FROM rws WHERE lp >= 3)
SELECT document_id, table_no, row_no, CAST(col_no AS INTEGER) AS col_no, header[col_no] AS header,
       cells[col_no] AS value
FROM (SELECT *, unnest(range(1, greatest(len(header), len(cells)) + 1)) AS col_no FROM body)"""

    s["table_verbalize"] = f"WITH {both}, {ELEMENTS}, {TABLES} SELECT document_id, table_no, text FROM v_tables"
    s["table_chunks"] = (f"WITH RECURSIVE {EVENT_REPORTS}, {ELEMENTS}, {TABLES}, {CHUNKS} "
                         f"SELECT document_id, chunk_index, source_kind, text, total_chunks, tables_found FROM chunks")

    s["chunk_union"] = f"{CORPUS_CHUNKS} SELECT document_id, chunk_index, source_kind, text FROM chunks"

    s["chunk_metadata"] = (f"{CORPUS_CHUNKS} SELECT document_id, chunk_index, source_kind, source, lang, "
                           f"total_chunks, tables_found, CAST(length(text) AS INTEGER) AS n_chars FROM chunks")

    s["metric_fanout"] = (f"WITH {CORPUS} SELECT d.document_id, c.cat_ord, c.metric_ord, c.category, c.metric_id "
                          f"FROM corpus d CROSS JOIN {ESG} c")

    # candidates
    cand = candidates("cands", CANDIDATE_KEYWORDS)
    s["metric_candidates"] = f"{CORPUS_CHUNKS}, {cand} SELECT * EXCLUDE (source_kind) FROM cands"
    s["value_normalize"] = (f"{CORPUS_CHUNKS}, {cand} SELECT * EXCLUDE (source_kind), {value_norm('value_raw', 'scale', 'negative')} AS value, "
                            f"{value_norm('high_raw', 'scale', 'negative')} AS value_high, {unit_norm('unit')} AS unit_norm FROM cands")

    # vectors
    cterms = terms_cte("ct", "chunks", ["document_id", "chunk_index"])
    s["hash_embed"] = f"{CORPUS_CHUNKS}, {cterms} SELECT * FROM ct"
    qterms = terms_cte("qt", "qtext", ["query_id"])
    s["metric_query_vectors"] = f"WITH {query_texts(ALL_CATALOG, True)}, {qterms} SELECT * FROM qt"
    hits = sparse_hits("hits", "ct", "qt", 3, False)
    s["knn_sparse"] = (f"{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, True)}, {qterms}, {hits} "
                       f"SELECT query_id, document_id, chunk_index, rank, round(score, 6) AS score FROM hits")
    ctx = """
ctx AS (SELECT h.query_id, string_agg(c.text, chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN chunks c USING (document_id, chunk_index) GROUP BY h.query_id)"""
    s["metric_context"] = (f"{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, True)}, {qterms}, {hits}, {ctx} "
                           f"SELECT query_id, context FROM ctx")
    prompt_rows = " UNION ALL ".join(
        f"SELECT {q(m.metric_id)} AS metric_id, {q(PROMPT_TEMPLATE % m.name)} AS head" for m in ALL_CATALOG)
    s["metric_prompt"] = (f"{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, False)}, {qterms}, {hits}, {ctx} "
                          f"SELECT p.metric_id, p.head || {NL} || {NL} || ctx.context AS prompt "
                          f"FROM ctx JOIN ({prompt_rows}) p ON p.metric_id = ctx.query_id")

    plain_rows = " UNION ALL ".join(
        f"SELECT {q(m.metric_id)} AS metric_id, {q(PLAIN_TEMPLATE % m.name)} AS head" for m in ALL_CATALOG)
    s["metric_prompt_plain"] = (f"{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, False)}, {qterms}, {hits}, {ctx} "
                                f"SELECT p.metric_id, p.head || {NL} || {NL} || ctx.context AS prompt "
                                f"FROM ctx JOIN ({plain_rows}) p ON p.metric_id = ctx.query_id")

    # rule extraction
    kws = [(m.metric_id, kw) for m in ALL_CATALOG for kw in m.keywords]
    kwmap = ", ".join(f"({q(a)}, {q(b)})" for a, b in kws)
    mhits = sparse_hits("mh", "ct", "qt", 3, True)
    s["document_answers"] = f"""
{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, False)}, {qterms}, {mhits},
dctx AS (SELECT h.document_id, h.query_id, string_agg(c.text, {NL} ORDER BY h.rank) AS context
         FROM mh h JOIN chunks c USING (document_id, chunk_index) GROUP BY h.document_id, h.query_id)
SELECT d.document_id, c.name AS item, regexp_extract(d.context, '[0-9]+') AS value, 'context' AS source, c.category,
       c.metric_id, round(CAST(least(length(d.context), 2400) AS DOUBLE) / 2400, 6) AS confidence, '' AS trend
FROM dctx d JOIN {ALLCAT} c ON c.metric_id = d.query_id"""
    extract = f"""
{CORPUS_CHUNKS}, {cterms}, {query_texts(ALL_CATALOG, False)}, {qterms}, {mhits},{candidates("xc", [kw for _, kw in kws])},
xj AS (
  SELECT x.*, km.metric_id, h.rank AS chunk_rank, h.score, c.category, c.name, c.unit AS cat_unit,
         CASE WHEN {unit_norm('x.unit')} IS NULL THEN 0.5 WHEN {unit_norm('x.unit')} = {unit_norm('c.unit')} THEN 1.0 ELSE 0.0 END AS unit_match
  FROM xc x JOIN (VALUES {kwmap}) km(metric_id, keyword) USING (keyword)
       JOIN mh h ON h.query_id = km.metric_id AND h.document_id = x.document_id AND h.chunk_index = x.chunk_index
       JOIN {ALLCAT} c ON c.metric_id = km.metric_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, metric_id
                   ORDER BY unit_match DESC, gap, chunk_rank, chunk_index, keyword, ordinal) AS rn FROM xj)
  WHERE rn = 1),
extracted AS (
  SELECT document_id, metric_id, category, name AS item, keyword, value_raw,
         {value_norm('value_raw', 'scale', 'negative')} AS value, {unit_norm('unit')} AS unit, chunk_index,
         chunk_rank AS rank, source_kind, document_id || '#' || CAST(chunk_index AS VARCHAR) AS source, gap, score,
         round(0.5 * unit_match + 0.3 / (1.0 + gap / 10.0) + 0.2 * greatest(score, 0.0), 4) AS confidence
  FROM best)"""
    s["extract_metrics"] = (f"{extract} SELECT document_id, metric_id, category, item, keyword, value_raw, "
                            f"value, unit, chunk_index, rank, source_kind, source, gap, "
                            f"round(score, 6) AS score, confidence FROM extracted")
    s["doc_summary"] = f"""{extract},
per_doc AS (SELECT document_id, max(total_chunks) AS n_chunks, max(tables_found) AS n_tables,
                   count(*) FILTER (WHERE source_kind = 'table') AS n_table_chunks FROM chunks GROUP BY document_id),
nres AS (SELECT document_id, count(*) AS n FROM extracted GROUP BY document_id)
SELECT d.document_id, coalesce(p.n_chunks, 0) AS n_chunks, coalesce(p.n_tables, 0) AS n_tables,
       coalesce(p.n_table_chunks, 0) AS n_table_chunks, coalesce(nres.n, 0) AS n_results
FROM (SELECT DISTINCT document_id FROM corpus) d LEFT JOIN per_doc p USING (document_id) LEFT JOIN nres USING (document_id)"""

    n_of = lambda cond: f"count(*) FILTER (WHERE {cond})"
    cats = ", ".join(f"{n_of('category = ' + q(a))} AS c_{a}" for a in CATEGORY_LABELS)
    cat_lines = " || ".join(f"{NL} || {q('- ' + b + '：')} || coalesce(c_{a}, 0)" for a, b in CATEGORY_LABELS.items())
    s["report_text"] = f"""{extract},
per_doc AS (SELECT document_id, max(total_chunks) AS n_chunks, max(tables_found) AS n_tables FROM chunks GROUP BY document_id),
nres AS (SELECT document_id, count(*) AS n, {n_of('confidence >= 0.8')} AS hi, {n_of('confidence >= 0.5 AND confidence < 0.8')} AS mid,
                {n_of('confidence < 0.5')} AS lo, {cats} FROM extracted GROUP BY document_id)
SELECT d.document_id, '# ' || d.document_id || {NL} || '- 大小：' || printf('%.2f', strlen(coalesce(d.text, '')) / 1048576.0) || ' MB' || {NL}
       || '- 文字段：' || coalesce(n_chunks, 0) || {NL} || '- 表格：' || coalesce(n_tables, 0) || {NL} || '- 指標：' || coalesce(n, 0) || {NL}
       || '- 把握高／中／低：' || coalesce(hi, 0) || '／' || coalesce(mid, 0) || '／' || coalesce(lo, 0) || {cat_lines} || {NL}
       || '- 完成：2024-01-31 12:00:00' AS report
FROM corpus d LEFT JOIN per_doc USING (document_id) LEFT JOIN nres USING (document_id)"""

    # dense vectors
    cent = """
cent0 AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT 'label-' || CAST(label AS VARCHAR) AS query_id, label,
                list(round(m, 6) ORDER BY pos) AS qvec
         FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM cent0 GROUP BY label, pos) GROUP BY label)"""

    def dense(metric: str, scoped: bool) -> str:
        dot = ("list_sum(list_transform(range(1, len(v.embedding) + 1), "
               "lambda i: CAST(v.embedding[i] AS DOUBLE) * CAST(c.qvec[i] AS DOUBLE)))")
        vn = "sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
        qn = "sqrt(list_sum(list_transform(c.qvec, lambda x: x * x)))"
        l2 = ("sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), "
              "lambda i: (CAST(v.embedding[i] AS DOUBLE) - c.qvec[i]) * (CAST(v.embedding[i] AS DOUBLE) - c.qvec[i]))))")
        if metric == "cosine":
            dist = (f"CASE WHEN len(v.embedding) = len(c.qvec) AND {vn} * {qn} > 0 "
                    f"THEN 1.0 - {dot} / ({vn} * {qn}) END")
        else:
            dist = f"CASE WHEN len(v.embedding) = len(c.qvec) THEN {l2} END"
        join = "JOIN cent c ON c.label = v.label" if scoped else "CROSS JOIN cent c"
        part = "c.query_id, v.label" if scoped else "c.query_id"
        order = "distance, v.vec_id" if scoped else "distance, v.vec_id, v.label"
        return f"""
WITH {cent},
sc AS (SELECT c.query_id, v.label, v.vec_id, {dist} AS distance FROM embeddings v {join}),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY {part.replace('c.', '').replace('v.', '')}
                   ORDER BY {order.replace('v.', '')}) AS INTEGER) AS rank
       FROM sc WHERE distance IS NOT NULL AND NOT isnan(distance))
SELECT query_id, label, vec_id, rank, round(distance, 6) AS distance, round(1.0 - distance, 6) AS score
FROM rk WHERE rank <= 3"""

    s["knn_cosine"] = dense("cosine", False)
    s["knn_l2"] = dense("l2", False)
    s["knn_per_document"] = dense("cosine", True)

    s["vector_validate"] = """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n_dims,
       CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason
FROM (SELECT *, CASE WHEN embedding IS NULL THEN 'null vector'
                     WHEN len(embedding) <> 64 THEN 'wrong width'
                     WHEN list_count(embedding) < len(embedding) THEN 'null element'
                     WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x))) THEN 'nan element'
                     WHEN list_bool_or(list_transform(embedding, lambda x: isinf(CAST(x AS FLOAT)))) THEN 'infinite element'
                     WHEN list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) = 0
                       THEN 'zero norm' END AS reason
      FROM embeddings)"""

    # stored vectors: hashed counts of 512 buckets, optionally weighted; distances as 1 - cosine
    vterms = terms_cte("vt", "chunks", ["document_id", "chunk_index"], 512)
    vqterms = terms_cte("vq", "qtext", ["query_id"], 512)
    weights = """
wn AS (SELECT count(*) AS n FROM chunks),
wdf AS (SELECT bucket, count(*) AS df FROM vt GROUP BY bucket),
weights AS (SELECT b.bucket, coalesce(df, 0) AS df, CAST(round(1000 * (1 + ln((1 + n) / (1 + coalesce(df, 0)))), 0) AS BIGINT) AS weight
            FROM (SELECT unnest(range(512)) AS bucket) b LEFT JOIN wdf USING (bucket) CROSS JOIN wn)"""
    s["bucket_weights"] = f"{CORPUS_CHUNKS}, {vterms}, {weights} SELECT bucket, df, weight FROM weights"

    def weighted(name: str, src: str, keys: str) -> str:
        return f"""
{name} AS (SELECT *, sum(tf * tf) OVER (PARTITION BY {keys}) AS norm2 FROM (SELECT {keys}, bucket, CAST(tf * weight AS DOUBLE) AS tf FROM {src} JOIN weights USING (bucket)))"""

    def vector_hits(chunk_terms: str, query_terms: str, scope: str = "") -> str:
        part = "query_id, document_id" if scope else "query_id"
        return f"""
vpairs AS (SELECT * FROM (SELECT document_id, chunk_index, any_value(norm2) AS cn FROM {chunk_terms} c {scope} GROUP BY document_id, chunk_index)
           CROSS JOIN (SELECT query_id, any_value(norm2) AS qn FROM {query_terms} GROUP BY query_id)),
vdots AS (SELECT q.query_id, c.document_id, c.chunk_index, CAST(sum(c.tf * q.tf) AS DOUBLE) AS dot
          FROM {chunk_terms} c JOIN {query_terms} q USING (bucket) {scope} GROUP BY q.query_id, c.document_id, c.chunk_index),
vs AS (SELECT query_id, document_id, chunk_index, 1.0::DOUBLE - coalesce(dot, 0) / (sqrt(cn) * sqrt(qn)) AS distance
       FROM vpairs LEFT JOIN vdots USING (query_id, document_id, chunk_index)),
vh AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {part} ORDER BY distance, document_id, chunk_index) AS INTEGER) AS rank FROM vs)
       WHERE rank <= 3)
SELECT query_id, document_id, chunk_index, rank, round(distance, 6) AS distance, round(1.0 - distance, 6) AS score, text, source, lang,
       CAST(total_chunks AS VARCHAR) AS total_chunks
FROM vh JOIN chunks USING (document_id, chunk_index)"""

    qt = query_texts(ALL_CATALOG, True)
    s["vector_search"] = f"{CORPUS_CHUNKS}, {vterms}, {qt}, {vqterms}, {vector_hits('vt', 'vq')}"
    s["vector_search_idf"] = (f"{CORPUS_CHUNKS}, {vterms}, {weights}, {qt}, {vqterms}, {weighted('wt', 'vt', 'document_id, chunk_index')}, "
                              f"{weighted('wq', 'vq', 'query_id')}, {vector_hits('wt', 'wq')}")
    toxic = "WHERE c.document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"
    s["vector_search_document"] = (f"{CORPUS_CHUNKS}, {vterms}, {query_texts(ALL_CATALOG, False)}, {vqterms}, "
                                   f"{vector_hits('vt', 'vq', toxic)}")
    held = "held AS (SELECT document_id, chunk_index, sqrt(any_value(norm2)) AS norm FROM vt GROUP BY document_id, chunk_index)"
    s["batch_alignment"] = f"""{CORPUS_CHUNKS}, {vterms}, {held}
SELECT document_id, chunk_index, 1 AS has_text, CAST(h.norm IS NOT NULL AS INTEGER) AS has_vector,
       CASE WHEN h.norm IS NOT NULL THEN 'aligned' ELSE 'text_only' END AS status
FROM chunks LEFT JOIN held h USING (document_id, chunk_index)"""

    s["chunk_vector_join"] = f"""{CORPUS_CHUNKS}, {vterms}, {held}
SELECT document_id, chunk_index, CAST(length(text) AS BIGINT) AS n_chars, CAST(512 AS BIGINT) AS n_dims, round(norm, 6) AS norm
FROM chunks JOIN held USING (document_id, chunk_index)"""

    # files
    names = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    s["file_scan"] = " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, '.parquet' AS file_type, count(*) AS n_rows, true AS sized, true AS dated FROM {t}"
                                        for t in names)
    manifest = """
man AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name,
               length(html) AS n FROM pages)"""
    s["doc_manifest"] = (f"WITH {manifest} SELECT page_id, url, file_name, "
                         f"lower(regexp_extract(file_name, '^.+(\\.[^.]+)$', 1)) AS file_type, "
                         f"CAST(n AS BIGINT) AS n_chars FROM man")
    allowed = ", ".join(q(x) for x in SERVICE_FORMATS + TEXT_FORMATS)
    s["format_gate"] = f"""
WITH {manifest}, ft AS (SELECT page_id, lower(regexp_extract(file_name, '^.+(\\.[^.]+)$', 1)) AS file_type FROM man)
SELECT page_id, file_type,
       CASE WHEN file_type IN ({allowed}) THEN 'accepted' ELSE 'rejected' END AS status,
       CASE WHEN file_type IN ({allowed}) THEN NULL WHEN file_type = '' THEN 'no file type'
            ELSE 'unsupported file type ' || file_type END AS reason
FROM ft"""

    # answers
    s["response_parse"] = (f"{ANSWERS_WITH} SELECT document_id, response_id, metric_id, value, source, "
                           f"round(confidence, 6) AS confidence, trend FROM kept")
    s["response_rejects"] = (f"{ANSWERS_WITH} SELECT document_id, response_id, metric_id, reason FROM parsed "
                             f"WHERE reason IS NOT NULL")
    s["answers_with_value"] = (f"{ANSWERS_WITH} SELECT document_id, response_id, metric_id, value, source, "
                               f"round(confidence, 6) AS confidence, trend FROM kept "
                               f"WHERE value IS NOT NULL AND value <> ''")
    s["result_rows"] = (f"{ANSWERS_WITH} SELECT document_id, response_id, item, value, source, category, "
                        f"metric_id, round(confidence, 6) AS confidence, trend FROM results")
    s["ordered_results"] = f"""{ANSWERS_WITH}
SELECT r.document_id, CAST(row_number() OVER (PARTITION BY r.document_id ORDER BY c.cat_ord, c.metric_ord, r.response_id) AS INTEGER) AS position,
       r.response_id, r.item, r.value, r.category, r.metric_id
FROM results r JOIN {ESG} c USING (metric_id) ORDER BY r.document_id, position"""
    s["confidence_buckets"] = f"""{ANSWERS_WITH}
SELECT document_id, count(*) FILTER (WHERE confidence >= 0.8) AS n_high,
       count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS n_mid,
       count(*) FILTER (WHERE confidence < 0.5) AS n_low
FROM results GROUP BY document_id"""
    s["confidence_buckets_closed"] = f"""{ANSWERS_WITH}
SELECT document_id, count(*) FILTER (WHERE confidence >= 0.8) AS n_high,
       count(*) FILTER (WHERE confidence BETWEEN 0.5 AND 0.8) AS n_mid,
       count(*) FILTER (WHERE confidence < 0.5) AS n_low
FROM results GROUP BY document_id"""
    s["confidence_share"] = f"""{ANSWERS_WITH},
b AS ({s['confidence_buckets'].split(ANSWERS_WITH, 1)[1]}),
l AS (SELECT document_id, 'high' AS bucket, n_high AS n FROM b UNION ALL
      SELECT document_id, 'mid', n_mid FROM b UNION ALL SELECT document_id, 'low', n_low FROM b)
SELECT document_id, bucket, n,
       round(CASE WHEN sum(n) OVER (PARTITION BY document_id) > 0
                  THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY document_id) END, 6) AS share
FROM l"""
    labels = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in CATEGORY_LABELS.items())
    s["category_counts"] = (f"{ANSWERS_WITH} SELECT category, count(*) AS n, CASE category {labels} END AS label "
                            f"FROM results GROUP BY category")
    s["report_rollup"] = f"""{ANSWERS_WITH}
SELECT category, metric_id, CAST(grouping_id(category, metric_id) AS BIGINT) AS level, count(*) AS n_results,
       count(*) FILTER (WHERE confidence >= 0.8) AS n_high, round(avg(confidence), 6) AS avg_confidence
FROM results GROUP BY ROLLUP (category, metric_id)"""
    s["metric_stats"] = f"""{ANSWERS_WITH}
SELECT metric_id, count(*) AS n, round(avg(confidence), 6) AS avg_confidence,
       round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence,
       round(avg(value_num), 6) AS avg_value, round(min(value_num), 6) AS min_value,
       round(max(value_num), 6) AS max_value
FROM results GROUP BY metric_id"""
    s["metric_coverage_gap"] = f"""{ANSWERS_WITH},
users AS (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS document_id FROM events)
SELECT u.document_id, c.metric_id, c.category FROM users u CROSS JOIN {ESG} c
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.document_id = u.document_id AND r.metric_id = c.metric_id)"""

    s["validate_range"] = (f"{ANSWERS_WITH}, {TRENDS}, {VALIDATION_RULES} SELECT document_id, response_id, metric_id, "
                           f"round(value_num, 6) AS value, vmin, vmax, status FROM v_range")
    s["validate_recommended"] = (f"{ANSWERS_WITH}, {TRENDS}, {VALIDATION_RULES} SELECT document_id, response_id, "
                                 f"metric_id, round(value_num, 6) AS value, recommended_min, severity FROM v_rec")
    s["validate_type"] = (f"{ANSWERS_WITH}, {TRENDS}, {VALIDATION_RULES} SELECT document_id, response_id, metric_id, "
                          f"type, unit, round(value_num, 6) AS value, status FROM v_type")
    s["validate_source"] = (f"{ANSWERS_WITH}, {TRENDS}, {VALIDATION_RULES} SELECT document_id, response_id, "
                            f"metric_id, source_kind, allowed, status FROM v_src")
    s["metric_trend"] = (f"WITH {TRENDS} SELECT user_id, metric_id, period, round(value, 6) AS value, "
                         f"round(prev_value, 6) AS prev_value, trend FROM trends")
    s["validate_trend"] = (f"WITH {ANSWERS}, {TRENDS}, {VALIDATION_RULES} SELECT user_id, metric_id, period, trend, "
                           f"declared, status FROM v_trend")
    rid = "document_id || '#' || CAST(response_id AS VARCHAR)"
    s["validation_report"] = f"""{ANSWERS_WITH}, {TRENDS}, {VALIDATION_RULES}
SELECT {rid} AS id, metric_id, 'range' AS rule, 'error' AS severity, {f4('value_num')} AS observed,
       '[' || {f4('vmin')} || ', ' || {f4('vmax')} || ']' AS expected FROM v_range WHERE status = 'fail'
UNION ALL
SELECT {rid}, metric_id, 'recommended', 'warning', {f4('value_num')}, '>= ' || {f4('recommended_min')}
FROM v_rec WHERE severity = 'warning'
UNION ALL
SELECT {rid}, metric_id, 'type', 'error', coalesce(unit, ''), type FROM v_type WHERE status = 'fail'
UNION ALL
SELECT {rid}, metric_id, 'source', 'error', source_kind, allowed FROM v_src WHERE status = 'fail'
UNION ALL
SELECT CAST(user_id AS VARCHAR) || '@' || CAST(period AS VARCHAR), metric_id, 'trend', 'warning', trend, declared
FROM v_trend WHERE status = 'fail'"""
    return s


ORACLE_SQL = _sql()
