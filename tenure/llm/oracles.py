"""The same results as DuckDB SQL, where SQL can state them on whole tables."""

from __future__ import annotations

MIX = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws('|', '7', doc_id::VARCHAR,
                       CASE WHEN doc_id IS NULL THEN '|' || text END)) AS draw
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sources
), levels AS (
  SELECT *, most / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER ()
            - (sum(most) OVER up_to - most)) / sum(weight) OVER onwards AS level
  FROM weighed
  WINDOW up_to AS (ORDER BY most / weight, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         onwards AS (ORDER BY most / weight, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size,
         least(most, max(CASE WHEN level <= full_at THEN level END) OVER () * weight) AS target
  FROM levels
), quotients AS (
  -- More seats than a source can get; every one has a quotient.
  SELECT source, house, target / (2 * k - 1) AS quotient
  FROM (SELECT source, target, unnest(range(1, (target / 32)::BIGINT + n + 3)) AS k, house
        FROM (SELECT *, count(*) OVER () AS n,
                     floor(1.5::DOUBLE * sum(source_size) OVER () / 32 + 0.5) AS house
              FROM targets))
  WHERE target > 0
), seated AS (
  SELECT source, count(*) * 32 AS seats
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST) AS place
        FROM quotients)
  WHERE place <= house
  GROUP BY source
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start,
         coalesce(q.seats, 0) AS seats
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  LEFT JOIN seated q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       (greatest(least(seats - start, size), 0)
        + greatest(least(seats - start - source_size, size), 0))::BIGINT AS taken
FROM placed
"""

CHAT = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok'
  FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role || text)
           + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM told GROUP BY conv_id
"""


MERKLE = r"""
WITH RECURSIVE told AS (
  SELECT *, CASE WHEN xor(list_reduce(
      [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ord(c)::BIGINT] || list_transform(range(8), lambda i: -1::BIGINT))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                        ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    ELSE text END AS now
  FROM documents
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS given
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
          || coalesce(strlen(source) || ':' || source, '-')
          || coalesce(strlen(lang) || ':' || lang, '-')
          || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM told)
), placed AS (
  SELECT *, coalesce('+' || source, '') AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n
), subroots AS (
  SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 100 AS level, idx, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx))
  FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 16, n
), steps AS (
  SELECT p.doc_id, p.leaf, p.idx AS row_idx, p.tree, v.level, v.tree AS of, p.idx >> (4 * v.level) AS own
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) v ON v.tree = p.tree
  UNION ALL
  SELECT p.doc_id, p.leaf, p.idx, p.tree, v.level, '*', s.idx >> (4 * (v.level - 100))
  FROM placed p JOIN subroots s ON s.tree = p.tree
       JOIN (SELECT DISTINCT level FROM upper_nodes WHERE n > 1) v ON true
), members AS (
  SELECT s.tree, s.row_idx, s.level, s.own, n.idx, n.hash,
         dense_rank() OVER (PARTITION BY s.tree, s.row_idx ORDER BY s.level) AS step
  FROM steps s
  JOIN (SELECT * FROM nodes UNION ALL SELECT '*', * FROM upper_nodes) n
    ON n.tree = s.of AND n.level = s.level AND n.idx // 16 = s.own // 16
), proofs AS (
  SELECT tree, row_idx, string_agg(hash, '' ORDER BY step, idx) AS proof
  FROM members WHERE idx <> own GROUP BY tree, row_idx
), folded AS (
  SELECT tree, idx AS row_idx, 0::BIGINT AS step, given AS hash FROM placed
  UNION ALL
  SELECT m.tree, m.row_idx, m.step,
         sha256(string_agg(CASE WHEN m.idx = m.own THEN f.hash ELSE m.hash END,
                           '' ORDER BY m.idx))
  FROM folded f JOIN members m ON m.tree = f.tree AND m.row_idx = f.row_idx AND m.step = f.step + 1
  GROUP BY m.tree, m.row_idx, m.step
)
SELECT p.doc_id, p.leaf, s.hash AS subroot, r.hash AS root,
       sha256(coalesce(q.proof, '')) AS proof_sha256, f.hash AS folded_root, f.hash = r.hash AS verified
FROM placed p
JOIN subroots s ON s.tree = p.tree
JOIN (SELECT hash FROM upper_nodes WHERE n = 1) r ON true
LEFT JOIN proofs q ON q.tree = p.tree AND q.row_idx = p.idx
JOIN (SELECT tree, row_idx, arg_max(hash, step) AS hash FROM folded GROUP BY ALL) f
  ON f.tree = p.tree AND f.row_idx = p.idx
"""


PASSAGES = r"""
WITH told AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT row_no, doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS name
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS p FROM told)
), firsts AS (
  SELECT name, min(doc_id) AS first FROM windows GROUP BY name
), covered AS (
  SELECT DISTINCT row_no, unnest(range(p, p + 50)) AS p
  FROM windows JOIN firsts USING (name) WHERE doc_id > first
), every_word AS (
  SELECT row_no, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM told
), kept AS (
  SELECT row_no, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM every_word ANTI JOIN covered USING (row_no, p) GROUP BY row_no
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM told LEFT JOIN kept USING (row_no)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": MIX, "op10_chat_format": CHAT, "op12_substring_dedup": PASSAGES,
            "op13_merkle_manifest": MERKLE}
