"""DuckDB SQL of the operators that SQL can express. The others are tested
against plain-Python versions, exact round trips or held-out accuracy in
tests/llm."""

SQL: dict[str, str] = {
    "op2_line_dedup": r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), holders AS (
  SELECT key, min(doc_id) AS holder FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, h.holder IS NOT NULL AND h.holder <> k.doc_id AS gone FROM keyed k LEFT JOIN holders h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_embedding_dedup": r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a, usable b
  WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), parts AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT p.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN counts c ON p.vec_id = c.a
""",
    "op9_warc": r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages
), digests AS (SELECT *, sha1(payload) AS hex FROM payloads)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       -- 40 hex digits are eight groups of 20 bits, four base32 letters each
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM digests
""",
    "op10_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), sized AS (
  SELECT *, 4 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 2
            + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 7 AS written
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(written) + count(*) - 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op13_vector_codes": r"""
-- vectors of 64 components, distinct ids
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, p, list_slice(v, 4 * p + 1, 4 * p + 4) AS x FROM kept, range(16) t(p)
), code0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), near1 AS (
  SELECT k.vec_id, k.p, k.x, min(struct_pack(d := list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := c.e)) AS best
  FROM parts k JOIN code0 c ON k.p = c.p GROUP BY k.vec_id, k.p, k.x
), moved1 AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM near1, range(1, 5) t(i) GROUP BY p, best.e, i
  ) GROUP BY p, e
), code1 AS (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM code0 c LEFT JOIN moved1 m ON c.p = m.p AND c.e = m.e
), near2 AS (
  SELECT k.vec_id, k.p, k.x, min(struct_pack(d := list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := c.e)) AS best
  FROM parts k JOIN code1 c ON k.p = c.p GROUP BY k.vec_id, k.p, k.x
), moved2 AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM near2, range(1, 5) t(i) GROUP BY p, best.e, i
  ) GROUP BY p, e
), code2 AS (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM code1 c LEFT JOIN moved2 m ON c.p = m.p AND c.e = m.e
), near3 AS (
  SELECT k.vec_id, k.p, k.x, min(struct_pack(d := list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := c.e)) AS best
  FROM parts k JOIN code2 c ON k.p = c.p GROUP BY k.vec_id, k.p, k.x
), coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near3 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM code2
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, books.sha AS codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id, books
""",
}
