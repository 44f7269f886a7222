"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: crc32 of the decimal id, byte by byte and bit by bit; a prefix is named by a digest of its turns.
TRIE = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS lead,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
               lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.lead AND t.pos <= v.h
  UNION ALL
  SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h
), path AS (
  SELECT c, d, words, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY d)) AS node
  FROM (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, sha256(role) || sha256(text) AS turn,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM rebuilt)
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, any_value(d) AS d, min(c) AS first, count(*) AS n, any_value(words) AS words FROM path GROUP BY node
), ends AS (
  SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest
  FROM (SELECT c, max_by(node, d) AS node FROM path GROUP BY c) GROUP BY node
), parents AS (
  SELECT DISTINCT a.node, b.node AS parent FROM path a JOIN path b ON a.c = b.c AND b.d = a.d - 1
), children AS (
  SELECT parent AS node, count(*) AS n FROM parents GROUP BY parent
), whole AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (node)
), summed AS (
  SELECT p.node, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n - 1) * w.words) AS saved
  FROM whole w JOIN path p ON p.c = w.first AND p.d <= w.d GROUP BY p.node
)
SELECT w.first::BIGINT AS conv_id, w.d::BIGINT AS depth, u.first::BIGINT AS parent_conv_id, w.n::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM whole w JOIN summed s USING (node) LEFT JOIN ends e USING (node) LEFT JOIN parents p USING (node) LEFT JOIN nodes u ON u.node = p.parent
"""
