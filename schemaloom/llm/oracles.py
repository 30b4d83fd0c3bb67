"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

_LINE_KEYS = r"""
lines AS (
  SELECT doc_id, u.i AS pos, u.line AS line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS i) u
),
often AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
"""

OP6 = f"""
WITH {_LINE_KEYS}
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.key IS NOT NULL AND l.doc_id <> o.last) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE o.key IS NULL OR l.doc_id = o.last), '')) AS kept_sha256
FROM lines l LEFT JOIN often o ON l.key = o.key
GROUP BY l.doc_id
"""

OP3 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM words, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size
),
hits AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + size)) AS j) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT digest, max(page_id) AS ref FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN r.ref > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r.ref > p.page_id THEN r.ref END AS refers_to
FROM p LEFT JOIN r ON p.digest = r.digest AND p.n >= 1000
"""

OP10 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM rows
),
checked AS (
  SELECT *, CASE coalesce(lag(role) OVER w, '') WHEN '' THEN p = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user'
              WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS ok
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY p)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(!*)\|', '<!\1|', 'g') || chr(10)
           || regexp_replace(text, '<(!*)\|', '<!\1|', 'g') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
       bool_and(ok) AND arg_max(role, p) = 'assistant' AS valid_order
FROM checked GROUP BY conv_id
"""


def oracles() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op6_line_dedup": OP6, "op8_warc": OP8, "op10_chat": OP10}
