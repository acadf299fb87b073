"""SQL counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap FROM named),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - coalesce(sum(cap) OVER need, 0e0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER need, 0e0)) AS level,
    coalesce(sum(cap) OVER need, 0e0) AS cap_before
  FROM capped
  WINDOW need AS (ORDER BY cap / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, weight, CASE WHEN cap <= weight * level THEN cap ELSE least(cap, weight * (
    SELECT min_by(level, cap_before) FROM levels WHERE NOT cap <= weight * level)) END AS target
  FROM levels),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goals),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.weight, p.target, p.passes,
    coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM sized s JOIN passes p ON s.source IS NOT DISTINCT FROM p.source),
drawn AS (
  SELECT *, CASE WHEN size > 0 THEN passes + CAST(
    2 * before + size <= 2 * (target - passes * source_size) AS INT) ELSE 0 END AS copies FROM placed),
asked AS (
  SELECT *, least((before + size / 2e0) / target, 1e0) AS y,
    CASE weight WHEN 5 THEN 1.5e0 WHEN 2 THEN 1e0 ELSE 0.5e0 END AS w0,
    CASE weight WHEN 5 THEN -1e0 WHEN 2 THEN 0e0 ELSE 1e0 END AS slope FROM drawn)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(2e0 * y / (w0 + sqrt(w0 * w0 + 2e0 * slope * y)), 9) END AS first_position
FROM asked
"""

TOPK = """
WITH usable AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT * FROM usable WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN usable c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same),
negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 100 * n.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5
"""

TRIE = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn ASC NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (
  SELECT *, xor(4294967295, list_reduce(
    [CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')],
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, bit: xor(r >> 1, 3988292384 * (r & 1))))) % 9 AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (
  SELECT conv_id, len(turns) AS total, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM members GROUP BY ALL),
sized AS (
  SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].text) END AS saved FROM nodes),
kids AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM sized WHERE depth > 0 GROUP BY 1),
full_nodes AS (
  SELECT s.*, coalesce(k.n_children, 0) AS n_children FROM sized s LEFT JOIN kids k ON s.prefix = k.prefix),
above AS (
  SELECT unnest(range(0, depth + 1)) AS stem, prefix, n_children, saved FROM full_nodes),
sums AS (
  SELECT prefix[1:stem] AS prefix, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.prefix = n.prefix
LEFT JOIN full_nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""

STATEMENTS: dict[str, str] = {
    "op7_exact_topk": TOPK,
    "op9_curriculum_mix": MIXING,
    "op11_hard_negatives": NEGATIVES,
    "op13_conversation_trie": TRIE,
}
