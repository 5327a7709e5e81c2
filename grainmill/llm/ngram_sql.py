"""SQL that gives the n-gram join's rows, for tables of some thousand documents."""

SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT i, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS g FROM d),
t AS (SELECT i, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (SELECT a.i AS a, b.i AS b FROM t a JOIN t b ON a.x = b.x AND a.i < b.i GROUP BY a.i, b.i, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT i AS a, i AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, max(len(s.g))::BIGINT AS n_shingles, min(o.doc_id)::BIGINT AS component_id
FROM s JOIN reach ON s.i = reach.a JOIN s o ON o.i = reach.b GROUP BY s.i, s.doc_id"""
