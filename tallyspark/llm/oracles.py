"""DuckDB SQL for the corpus queries that SQL can express."""

SQL = {
    "op2_benchmark_decontamination": r"""
WITH texts AS (
  SELECT true AS item, item_id AS id, lower(text) AS t FROM benchmark WHERE item_id IS NOT NULL
  UNION ALL SELECT false, doc_id, lower(text) FROM documents
), tokens AS (
  SELECT item, id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM texts
), sets AS (
  SELECT item, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM tokens
), postings AS (
  SELECT item, id, len(s) AS n, unnest(s) AS g FROM sets
)
SELECT d.id AS doc_id, i.id AS item_id, count(*)::BIGINT AS n_shared, any_value(i.n)::BIGINT AS n_item,
  round(count(*) / any_value(i.n), 6) AS containment
FROM postings d JOIN postings i ON d.g = i.g AND i.item AND NOT d.item
GROUP BY d.id, i.id
HAVING 100 * count(*) >= 80 * any_value(i.n)
""",
    "op6_exact_topk": r"""
WITH v AS (
  SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM tokens
), postings AS (
  SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM postings a JOIN postings b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r.b) FROM reach r WHERE r.a = sets.doc_id)::BIGINT AS component_id
FROM sets
""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, (place % 3 + 1)::DOUBLE AS weight, ([-0.5, 0.0, 0.5])[(place % 3 + 1)::INT]::DOUBLE AS slope,
    (3 * source_size)::DOUBLE AS most
  FROM by_source
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, slope,
    round(CASE WHEN lv IS NULL THEN most ELSE least(most, lv * weight) END, 6) AS target
  FROM (SELECT *, max(level) FILTER (WHERE most > level * weight) OVER () AS lv FROM levels)
), ran AS (
  SELECT s.doc_id, s.size, s.source, t.source_size, t.target, t.slope,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before,
    round(t.target)::BIGINT AS goal
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS passes FROM ran
), done AS (
  SELECT *, (passes * size + greatest(0, least(size, goal - passes * source_size - before)))::BIGINT AS taken,
    least(1.0::DOUBLE, CASE WHEN target > 0 THEN before / greatest(target, 1e-9::DOUBLE) ELSE 0.0 END) AS x
  FROM passed
)
SELECT doc_id, size, source_size, target, taken, source,
  (CASE WHEN size > 0 THEN ceil(taken / size) ELSE 0 END)::BIGINT AS copies,
  CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN x ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * x) - (1 - slope)) / (2 * slope) END, 9) + 0.0::DOUBLE END AS position
FROM done
""",
}
