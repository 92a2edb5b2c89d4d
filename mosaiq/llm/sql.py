"""SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

OP7 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, 'h' || coalesce(source, '') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid
  FROM documents),
pos AS (SELECT rid, generate_series AS i, array_to_string(list_slice(w, generate_series, generate_series + 7), ' ') AS win
        FROM d, generate_series(1, greatest(len(w) - 7, 0)) WHERE len(w) > 8),
rep AS (SELECT rid, i FROM pos QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, generate_series(0, 7) AS s(k) GROUP BY rid),
raw AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lin AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) AS norm,
               len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
        FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lin GROUP BY rid),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT rid) AS n FROM lin GROUP BY host, norm) JOIN hosts USING (host)
         WHERE n > 20 AND (n * 100 > docs * 2.0 OR n > 10000)),
gone AS (SELECT rid, sum(words) AS removed_words FROM lin JOIN freq USING (host, norm) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
      FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - removed_words) * 100 < n_words * 20 AS kept
FROM f
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, source,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 2 * source_size AS cap FROM s),
v AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM w),
b AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100.0e0 AS budget,
             coalesce(sum(cap) OVER o, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
      FROM v WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - CAST(cap_before AS DOUBLE)) / CAST(weight_left AS DOUBLE) AS level FROM b),
x AS (SELECT level AS level FROM l WHERE cap >= level * weight ORDER BY CAST(cap AS DOUBLE) / weight, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN x.level * weight < cap THEN x.level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l, x),
p AS (SELECT doc_id, size, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, CAST(floor(target + 0.5e0) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""

OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS rid
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
      FROM v AS a JOIN v AS b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_exact_top_k": OP3, "op4_source_mixing": OP4, "op7_quality_rules": OP7}
