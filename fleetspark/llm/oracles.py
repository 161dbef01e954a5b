"""DuckDB SQL for the queries that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Least node that each row of ``edge`` (a, b), both ways, leads to.
REACH = "reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"

ORACLE_SQL = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda p: w[p:p + 9]) ELSE [w] END) AS x FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(x)::BIGINT AS n FROM win),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w)::BIGINT - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, p, n FROM spot JOIN win ON win.x = spot.w[p:p + n - 1]),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_near_embeddings": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
edge AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.98),
{REACH}, n AS (SELECT a, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least l ON l.a = vec_id""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
edge AS (SELECT p.doc_id AS a, q.doc_id AS b FROM e p JOIN e q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
{REACH}
SELECT doc_id, len(x)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN least ON a = doc_id""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
numbered AS (SELECT row_number() OVER () AS r, doc_id, w FROM d),
whole AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
i AS (SELECT DISTINCT item_id, unnest(coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])) AS term FROM benchmark),
word AS (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM numbered),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM word WHERE term IN (SELECT term FROM i) GROUP BY r, doc_id, n, term),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * max(n) + 2) / (2.0::DOUBLE * max(df) + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), (SELECT n FROM whole) GROUP BY term),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * tf.n * whole.n) // whole.l)))) AS s FROM tf JOIN weight USING (term), whole),
scored AS (SELECT item_id, r, doc_id, sum(s)::BIGINT AS score FROM part JOIN i USING (term) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
