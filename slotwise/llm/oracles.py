"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from slotwise.llm.mixing import SEED

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS t_len,
         length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) AS r_len
  FROM numbered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(t_len + CASE WHEN before = role THEN length('<next>')
                        ELSE length('<turn><text></turn>') + r_len END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_MIX = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(length(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per
), weighed AS (
  SELECT *, 1 + k % 3 AS w, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (1 + k % 3) AS full_at FROM ranked
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS draw
  FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) AS n
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(each * n + draw) - floor(each * (n - 1) + draw)))::BIGINT AS taken FROM placed
"""

_LINES = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(length(string_split(coalesce(text, ''), chr(10))))) AS n
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut
), counts AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, c.owner IS NOT NULL AND c.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN counts c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WARC = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM hashed)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM firsts
"""

_VECTORS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND length(e) > 0
    AND length(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND length(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND length(a.e) = length(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v LEFT JOIN least ON v.vec_id = least.x
"""

_SEARCH = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), per AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM per
), normed AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // total AS m FROM per, corpus
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN normed USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": _CHAT, "op2_warc": _WARC, "op3_embedding_near_dedup": _VECTORS,
                           "op5_line_dedup": _LINES, "op10_mixing": _MIX,
                           "op12_lexical_search": _SEARCH}
