"""The mix in SQL: one running sum over each whole source."""

ORACLE = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM rows GROUP BY source),
weighed AS (SELECT *, 1 + (place - 1) % 3 AS w FROM sources),
levels AS (
  SELECT max(CAST((SELECT sum(s) FROM weighed) - before AS DOUBLE) / ((SELECT sum(w) FROM weighed) - lighter)) AS level
  FROM (SELECT coalesce(sum(3 * s) OVER earlier, 0) AS before, coalesce(sum(w) OVER earlier, 0) AS lighter
    FROM weighed WINDOW earlier AS (ORDER BY CAST(s AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
budgets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), level * w) AS target FROM weighed, levels),
places AS (
  SELECT rows.*, s, target, CAST(floor(target) AS BIGINT) // greatest(s, 1) AS epochs, CAST(floor(target) AS BIGINT) % greatest(s, 1) AS rest,
    sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id NULLS FIRST, size, r) - size AS before
  FROM rows JOIN budgets ON rows.source IS NOT DISTINCT FROM budgets.source)
SELECT doc_id, size, s AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM places
"""
