"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYWORD = "|".join(_EITHER(w) for w in ("password", "passwd", "secret", "token")) + "|" + _EITHER("api") + "_?" + _EITHER("key")
_ASSIGN = f"""({_KEYWORD})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(no: int, kind: str, pattern: str, group: int, least: int) -> str:
    """(doc_id, no, kind, s, e): matches of a pattern, placed by the text between them."""
    return f"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, s, e FROM (
    SELECT doc_id, length(g) AS judged, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e,
           sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s
    FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs,
                       regexp_split_to_array(t, '{pattern}') AS gaps FROM docs)))
  WHERE judged >= {least}"""


_LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS k FROM lines),
several AS (SELECT k, min(doc_id) AS home FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, line, i, coalesce(home < doc_id, false) AS gone FROM keyed LEFT JOIN several USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_found(0, "assign", _ASSIGN, 2, 6)}
  UNION ALL {_found(1, "access", "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_found(2, "hex", "[0-9a-f]+", 0, 24)}
  UNION ALL {_found(3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)}),
listed AS (SELECT doc_id, no, kind, s, e, concat(kind, ':', s::BIGINT, ':', e::BIGINT) AS span FROM found)
SELECT docs.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, no) FILTER (WHERE no < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, no), '') AS spans
FROM docs LEFT JOIN listed USING (doc_id) GROUP BY docs.doc_id"""

_CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
rendered AS (
  SELECT conv_id, perspective, turn, speaker, t,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns JOIN speakers USING (conv_id)),
parts AS (
  SELECT *, concat('<|im_start|>', role, CASE WHEN role = 'user' THEN concat(' name=', replace(speaker, '<|', '< |')) ELSE '' END, chr(10)) AS head,
         concat(replace(t, '<|', '< |'), '<|im_end|>', chr(10)) AS body FROM rendered),
placed AS (
  SELECT *, concat(head, body) AS segment,
         sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, md5(concat(speaker, '|', t)), speaker, t
                                                ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM parts)
SELECT conv_id, perspective, turn, speaker, role, segment, stop - length(segment) AS "start", stop AS "end",
       CASE WHEN role = 'assistant' THEN stop - length(body) END AS mask_start, CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_end
FROM placed"""


def _shingles(name: str, key: str) -> str:
    return f"""(SELECT {key}, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g
  FROM (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {name}))"""


_LEAKS = f"""
WITH items AS {_shingles("benchmark", "item_id")}, docs AS {_shingles("documents", "doc_id")},
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM items JOIN docs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""

_WARC = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
chosen AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS home FROM payloads)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN home = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN home <> page_id THEN home END AS refers_to, 'ok' AS status
FROM chosen"""

def _clusters(k: int = 16, rounds: int = 3) -> str:
    """Rounds over (vec_id, i, x) and (c, i, y); a floored mean is the exact quotient after the remainder is taken off."""
    steps, at = [], "c0"
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT vec_id, c, d FROM (
  SELECT vec_id, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS place FROM (
    SELECT vec_id, c, sum((x - y) * (x - y))::BIGINT AS d FROM comps JOIN {at} USING (i) GROUP BY vec_id, c)) WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN comps USING (vec_id) GROUP BY c, i),
c{r + 1} AS (SELECT o.c, o.i, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y FROM {at} o LEFT JOIN m{r} m USING (c, i))""")
            at = f"c{r + 1}"
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
comps AS (SELECT vec_id, unnest(range(64)) AS i, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k}),
c0 AS (SELECT c, i, x AS y FROM firsts JOIN comps USING (vec_id)),{",".join(steps)},
named AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS sha FROM {at} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN named USING (c)"""


ORACLE_SQL = {"op2_line_dedup": _LINES, "op5_secret_scan": _SECRETS, "op7_chat_perspectives": _CHAT, "op8_decontamination": _LEAKS, "op9_warc": _WARC,
              "op12_centroid_clustering": _clusters()}
