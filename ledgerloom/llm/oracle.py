"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit (polynomial 0xEDB88320)."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    byte = "list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"
    )


ORACLE = {
    "op1_line_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS d, doc_id, text,
         regexp_extract_all(text, '[^\n]*?[.!?] |[^\n]*\n|[^\n]+') AS pieces
  FROM documents
), pieces AS (
  SELECT d, unnest(pieces) AS piece, unnest(range(len(pieces))) AS place FROM docs
), units AS (
  SELECT d, place, trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS unit,
         row_number() OVER (PARTITION BY d ORDER BY place) AS i
  FROM pieces WHERE trim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
), counted AS (
  SELECT *, len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) AS n FROM units
), runs AS (
  SELECT a.d, a.place AS lo, b.place AS hi, a.unit || chr(0) || p.unit || chr(0) || q.unit || chr(0) || b.unit AS run
  FROM units a JOIN units p ON p.d = a.d AND p.i = a.i + 1
  JOIN units q ON q.d = a.d AND q.i = a.i + 2 JOIN units b ON b.d = a.d AND b.i = a.i + 3
  UNION ALL
  SELECT d, place, place, unit FROM counted WHERE n >= 50
  UNION ALL
  SELECT a.d, a.place, b.place, a.unit || chr(0) || b.unit
  FROM counted a JOIN counted b ON b.d = a.d AND b.i = a.i + 1 WHERE a.n + b.n >= 50
  UNION ALL
  SELECT a.d, a.place, b.place, a.unit || chr(0) || p.unit || chr(0) || b.unit
  FROM counted a JOIN counted p ON p.d = a.d AND p.i = a.i + 1
  JOIN counted b ON b.d = a.d AND b.i = a.i + 2 WHERE a.n + p.n + b.n >= 50
), firsts AS (
  SELECT d, lo, hi, first_value(d) OVER w AS d0, first_value(hi) OVER w AS hi0
  FROM runs WINDOW w AS (PARTITION BY run ORDER BY d, lo)
), gone AS (
  SELECT DISTINCT d, unnest(range(lo, hi + 1)) AS place FROM firsts WHERE d <> d0 OR lo > hi0
), cut AS (
  SELECT p.d, coalesce(string_agg(p.piece, '' ORDER BY p.place) FILTER (g.place IS NULL), '') AS text,
         count(g.place) AS n_deleted
  FROM pieces p LEFT JOIN gone g ON g.d = p.d AND g.place = p.place GROUP BY p.d
)
SELECT docs.doc_id, coalesce(cut.text, docs.text) AS text,
       coalesce(n_deleted, 0)::BIGINT AS n_deleted
FROM docs LEFT JOIN cut USING (d)
""",
    "op3_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce((length(regexp_replace(text, '[^a-z]+', '', 'g')) + 1)::DOUBLE / (length(text) + 1), 1.0) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS ceiling,
         list_extract([5.0::DOUBLE, 2.0, 1.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight
  FROM sized GROUP BY source
), sums AS (
  SELECT *, (SELECT sum(size) FROM sized)::DOUBLE
              - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS room,
         sum(weight) OVER (ORDER BY ceiling / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sources
), levels AS (
  SELECT max(room / open) AS level FROM sums WHERE room / open <= ceiling / weight
), aims AS (
  SELECT source, source_size, least(ceiling, level * weight) AS target FROM sources, levels
), placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN aims USING (source)
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND 2 * (target - epochs * source_size - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
""",
    "op7_embedding_dedup": r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
""",
    "op11_prefix_trie": rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS family, {_crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.place, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.family AND t.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth,
         dense_rank() OVER (ORDER BY role, text) AS turn, length(text) AS size
  FROM rebuilt
), paths AS (
  SELECT conv_id, depth, size, list(turn) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), kids AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
), above AS (
  SELECT unnest(range(0, depth + 1)) AS top, path, (n_children = 0)::INT AS leaf, (n_convs - 1) * size AS saved
  FROM kids
), subtrees AS (
  SELECT path[1:top] AS path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM above GROUP BY 1
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM kids JOIN subtrees USING (path)
""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE spelled AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
           AS head
  FROM documents
), leaves AS (
  SELECT r, doc_id, coalesce('s' || source, '-') AS grp,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0
           THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
           ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed
  FROM spelled
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), levels AS (
  SELECT grp, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT *, count(*) OVER (PARTITION BY grp) FROM (
    SELECT grp, any_value(level) + 1 AS level, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM levels WHERE n > 1 GROUP BY grp, idx // 3)
), subroots AS (
  SELECT grp, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS level, idx, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT *, count(*) OVER () FROM (
    SELECT any_value(level) + 1 AS level, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
    FROM tops WHERE n > 1 GROUP BY idx // 3)
), every AS (
  SELECT 's' AS tree, grp, level, idx, digest FROM levels
  UNION ALL SELECT 't', '', level, idx, digest FROM tops
), steps AS (
  SELECT p.r, 0 AS part, l.level, l.idx FROM placed p JOIN subroots s USING (grp)
    JOIN levels l ON l.grp = p.grp AND l.level < s.height AND l.idx = p.idx // CAST(power(3, l.level) AS BIGINT)
  UNION ALL
  SELECT p.r, 1, t.level, t.idx FROM placed p JOIN subroots s USING (grp)
    JOIN tops t ON t.n > 1 AND t.idx = s.idx // CAST(power(3, t.level) AS BIGINT)
), walks AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, level) AS step, part, level, idx FROM steps
), siblings AS (
  SELECT w.r, w.step, coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx < w.idx), '') AS before,
         coalesce(string_agg(e.digest, '' ORDER BY e.idx) FILTER (e.idx > w.idx), '') AS behind
  FROM walks w JOIN placed p USING (r)
    JOIN every e ON e.tree = CASE w.part WHEN 0 THEN 's' ELSE 't' END AND e.grp = CASE w.part WHEN 0 THEN p.grp ELSE '' END
      AND e.level = w.level AND e.idx // 3 = w.idx // 3
  GROUP BY w.r, w.step
), folds AS (
  SELECT r, 0 AS step, claimed AS digest FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(s.before || f.digest || s.behind)
  FROM folds f JOIN siblings s ON s.r = f.r AND s.step = f.step + 1
), folded AS (SELECT r, arg_max(digest, step) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256 FROM siblings GROUP BY r),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (grp) JOIN folded USING (r) LEFT JOIN proofs USING (r), root
""",
}
