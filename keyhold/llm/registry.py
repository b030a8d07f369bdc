"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from keyhold.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in vars(q).items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END rest FROM pages),
 h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, substr(regexp_extract(rest, '^[^?#]*'), length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path FROM u),
 rules(verdict, rhost, rpath) AS (VALUES {", ".join(map(str, q.RULES))}),
 f AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) k
  FROM h JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.k = 1"""

OP2 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) sh FROM w),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
 r AS (SELECT doc_id, doc_id c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""

OP7 = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

OP8 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
 l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
 r AS (SELECT vec_id, vec_id c FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
 n AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n ON n.a = vec_id GROUP BY vec_id"""

#: CRC-32 of the decimal id, bit by bit.
_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: {_BITS}), 4294967295)"

OP11 = f"""WITH h AS (SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id::BIGINT c FROM conversations WHERE conv_id IS NOT NULL)),
 t AS (SELECT conv_id::BIGINT c, turn, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS x, length(coalesce(text, '')) AS chars FROM conversations),
 o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, x) - 1 AS pos FROM t),
 r AS (SELECT h.c, 0 AS part, pos, role, x, chars FROM h JOIN o ON o.c = h.c - h.c % 100 AND pos < h UNION ALL SELECT h.c, 1, pos, role, x, chars FROM h JOIN o ON o.c = h.c AND pos >= h),
 p AS (SELECT c, row_number() OVER w AS depth, string_agg(sha256(role) || x, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)
  UNION ALL SELECT c, 0, '', 0 FROM h),
 l AS (SELECT c, max(depth) AS depth FROM p GROUP BY c),
 n AS (SELECT path, depth, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM p GROUP BY path, depth),
 k AS (SELECT left(path, length(path) - 128) AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
 e AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM p JOIN l USING (c, depth) GROUP BY path),
 s AS (SELECT a.path, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n - 1) * n.chars) AS saved FROM n LEFT JOIN k USING (path) JOIN p a ON a.c = n.c AND a.depth <= n.depth GROUP BY a.path)
SELECT n.c AS conv_id, n.depth::BIGINT AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = left(n.path, length(n.path) - 128)"""

OP12 = """WITH v AS (SELECT vec_id::BIGINT id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
 s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
 p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
 n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op2_ngram_join": OP2, "op7_exact_dedup": OP7, "op8_embedding_dedup": OP8, "op11_conversation_trie": OP11, "op12_hard_negatives": OP12}
