"""DuckDB SQL of the operators that SQL can express. The others have brute-force tests."""

from __future__ import annotations

from gyrolens.llm import line_dedup, mixing

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce('s' || source, 'null') AS site FROM documents),
l AS (SELECT rid, site, u.line AS raw, trim(u.line) AS line, u.pos FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
b AS (SELECT line FROM l WHERE length(line) >= {line_dedup.MIN_CHARS} GROUP BY line HAVING count(DISTINCT site) >= {line_dedup.MIN_SITES}),
k AS (SELECT rid, count(*) AS n, count(b.line) AS gone, string_agg(CASE WHEN b.line IS NULL THEN raw END, chr(10) ORDER BY pos) AS kept FROM l LEFT JOIN b USING (line) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM d LEFT JOIN k USING (rid)
"""

OP3 = f"""
WITH q AS (
  SELECT doc_id, source IS NULL AS nosrc, coalesce(source, '') AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT nosrc, src, CAST(sum(size) AS BIGINT) AS source_size FROM q GROUP BY nosrc, src),
r AS (SELECT *, row_number() OVER (ORDER BY nosrc, src) AS rnk FROM s),
w AS (SELECT *, [5, 2, 1][(rnk - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM r),
c AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest, sum(source_size) OVER () AS total
  FROM w WINDOW o AS (ORDER BY cap / w, rnk)),
f AS (SELECT *, cap * w_rest <= w * (total - cap_before) AS capped FROM c),
t AS (SELECT nosrc, src, source_size, rnk, CASE WHEN capped THEN CAST(cap AS DOUBLE)
  ELSE CAST(w * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target FROM f),
p AS (SELECT doc_id, size, source_size, target, rnk, h, row_number() OVER o AS pos, sum(size) OVER (o ROWS UNBOUNDED PRECEDING) AS cum
  FROM q JOIN t USING (nosrc, src) WINDOW o AS (PARTITION BY nosrc, src ORDER BY h, doc_id NULLS FIRST, size)),
e AS (SELECT p.*, n.pass, CAST(n.pass * source_size + cum AS DOUBLE) / target AS finish FROM p, (VALUES (0), (1), (2)) AS n(pass) WHERE target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, rnk, pass, h, pos ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(source_size) FROM s) AS budget FROM e),
k AS (SELECT rnk, h, pos, count(*) AS n FROM m WHERE run <= budget GROUP BY rnk, h, pos)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken FROM p LEFT JOIN k USING (rnk, h, pos)
"""

OP6 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP10 = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM d
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
i AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM i) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM t, (SELECT unnest(generate_series(0, 7)) AS o) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT doc_id, w, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.lines, 0) AS n_lines,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS no_letter,
  (SELECT list(x) FROM (SELECT unnest(string_split(text, chr(10))) AS x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  len(list_filter(generate_series(1, len(w) - 1), lambda i: w[i] = w[i + 1])) AS stutter,
  coalesce(list_max(map_values(list_histogram(w))), 0) AS most
  FROM w LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.5 * n_lines OR no_letter > 0.2 * n_words
    OR len(list_filter(ls, lambda x: substr(regexp_extract(x, '[^\x20\x09-\x0D]+'), 1, 1) IN ('-', '*', '•', '‣'))) > 0.9 * n_lines
    OR len(list_filter(ls, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) > 0.3 * n_lines
    OR stutter > 0.3 * n_words OR most > 0.4 * n_words) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2, "op3_source_mix": OP3, "op5_quality": OP5, "op6_warc": OP6, "op10_ngram_join": OP10}
