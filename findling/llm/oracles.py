"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIX_SOURCES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
      FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS n,
             (sum(source_size) OVER ())::DOUBLE AS total FROM s),
g AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
h AS (SELECT *, least(cap, w * (SELECT level FROM g WHERE level * w <= cap ORDER BY n LIMIT 1)) AS target FROM g),
r AS (SELECT d.doc_id, d.size, h.source_size, h.target, floor(h.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM r
"""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

FILTER_URLS = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *,
  CASE WHEN regexp_matches(host || path, '^([^/]*\.)?example\.net/en/') THEN 'example.net/en/'
       WHEN regexp_matches(host || path, '^([^/]*\.)?example\.com/de/') THEN 'example.com/de/'
       WHEN regexp_matches(host || path, '^([^/]*\.)?org/fr/') THEN 'org/fr/'
       WHEN regexp_matches(host || path, '^([^/]*\.)?net/') THEN 'net/' END AS rule,
  CASE WHEN regexp_matches(host || path, '/ads/') THEN '/ads/'
       WHEN regexp_matches(host || path, '/login([^A-Za-z0-9_.%-]|$)') THEN '/login^'
       WHEN regexp_matches(host || path, '^([^/]*\.)?casino-(?s:.*)\.') THEN '||casino-*.'
       WHEN regexp_matches(host || path, '^([^/]*\.)?cheap-pills\.') THEN '||cheap-pills.'
       WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.') THEN '||spam-farm.' END AS hit FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern
FROM m
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

PREFIX_TRIE = r"""
WITH digits AS (
  -- CRC-32 of the decimal digits: each byte, then eight shifts (marked -1).
  SELECT conv_id, flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: [ord(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS steps
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
      FROM digits),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS i, m, n FROM (
        SELECT conv_id, turn, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations WHERE conv_id IS NOT NULL)),
r AS (SELECT c.conv_id, 0 AS part, t.i, t.m, t.n FROM c JOIN t ON t.conv_id = c.base WHERE t.i < c.h
      UNION ALL SELECT c.conv_id, 1, t.i, t.m, t.n FROM c JOIN t USING (conv_id) WHERE t.i >= c.h),
p AS (SELECT conv_id, row_number() OVER w AS depth, n AS words, string_agg(m, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
q AS (SELECT conv_id, 0 AS depth, 0 AS words, '' AS k FROM c UNION ALL SELECT * FROM p),
l AS (SELECT conv_id, max(depth) AS last FROM q GROUP BY conv_id),
n AS (SELECT k, any_value(depth) AS depth, min(q.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             string_agg(q.conv_id::VARCHAR, ',' ORDER BY q.conv_id) FILTER (depth = last) AS ends
      FROM q JOIN l USING (conv_id) GROUP BY k),
e AS (SELECT n.k, n.depth, n.conv_id, q.k AS up FROM n LEFT JOIN q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
ch AS (SELECT up AS k, count(*) AS n_children FROM e WHERE up IS NOT NULL GROUP BY up),
-- Every node under each of its prefixes.
s AS (SELECT a.k, count(*) FILTER (ch.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
      FROM n LEFT JOIN ch ON ch.k = n.k JOIN q a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(ch.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN e ON e.k = n.k LEFT JOIN n u ON u.k = e.up LEFT JOIN ch ON ch.k = n.k JOIN s ON s.k = n.k
"""

TOPK_SEARCH = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.row AS other, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op1_mix_sources": MIX_SOURCES, "op4_near_dedup": NEAR_DEDUP, "op8_exact_dedup": EXACT_DEDUP, "op9_filter_urls": FILTER_URLS, "op11_prefix_trie": PREFIX_TRIE, "op12_topk_search": TOPK_SEARCH}
