"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

#: {docs}: a table of documents; {columns}: what it has beside text, for the outermost select.
LINE_DEDUP = """
WITH raw AS (SELECT *, string_split(text, chr(10)) AS ls, left(md5(text), 7) AS row_id FROM {docs}),
l AS (SELECT doc_id, row_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM raw),
w AS (SELECT doc_id, row_id, line_no, list_filter(string_split_regex(lower(line), '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM l),
n AS (SELECT doc_id, row_id, line_no, array_to_string(ws, ' ') AS norm, len(ws) >= 5 AS by_word, {{'late': doc_id IS NULL, 'doc': doc_id, 'row': row_id, 'line_no': line_no}} AS place FROM w WHERE len(ws) > 0),
p AS (SELECT *, CASE WHEN by_word THEN string_split(norm, ' ') ELSE string_split(norm, '') END AS us FROM n),
d AS (SELECT norm, any_value(by_word) AS by_word, any_value(us) AS us, len(any_value(us)) AS n, min(place) AS first FROM p GROUP BY norm),
e AS (SELECT * FROM d WHERE by_word OR n >= 10),
each AS (SELECT norm, by_word, us, n, first, unnest(range(1, n + 1)) AS pos FROM e),
cut AS (SELECT norm, by_word, first, n, pos, CASE WHEN by_word THEN array_to_string(list_concat(us[1:pos - 1], us[pos + 1:]), ' ') ELSE array_to_string(list_concat(us[1:pos - 1], us[pos + 1:]), '') END AS key FROM each),
near AS (
  SELECT a.norm FROM cut a JOIN cut b ON a.key = b.key AND a.pos = b.pos AND a.n = b.n AND a.by_word = b.by_word WHERE b.first < a.first
  UNION SELECT a.norm FROM cut a JOIN e b ON a.key = b.norm AND a.by_word = b.by_word WHERE b.first < a.first
  UNION SELECT b.norm FROM cut a JOIN e b ON a.key = b.norm AND a.by_word = b.by_word WHERE a.first < b.first),
gone AS (SELECT p.doc_id, p.row_id, p.line_no, near.norm IS NOT NULL AS near FROM p JOIN d USING (norm) LEFT JOIN near USING (norm) WHERE near.norm IS NOT NULL OR p.place <> d.first),
g AS (SELECT doc_id, row_id, list(DISTINCT line_no) AS gone, count(DISTINCT line_no) FILTER (WHERE NOT near) AS n_exact, count(DISTINCT line_no) FILTER (WHERE near) AS n_near FROM gone GROUP BY doc_id, row_id)
SELECT {columns} CASE WHEN g.gone IS NULL THEN r.text ELSE array_to_string(list_filter(r.ls, lambda x, i: NOT list_contains(g.gone, i - 1)), chr(10)) END AS text,
  CAST(coalesce(len(r.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(g.n_exact, 0) AS INTEGER) AS n_exact, CAST(coalesce(g.n_near, 0) AS INTEGER) AS n_near
FROM raw r LEFT JOIN g ON r.doc_id IS NOT DISTINCT FROM g.doc_id AND r.row_id = g.row_id
"""

SQL = {
    "op2_line_dedup": LINE_DEDUP.format(docs="documents", columns="r.doc_id,"),
}
