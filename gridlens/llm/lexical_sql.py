"""The ranking in SQL: the score of every document that shares a term with an item."""

TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLE = f"""
WITH asked AS (SELECT uid, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS uid, item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY uid, item_id, term),
docs AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents) WHERE len(terms) > 0),
sums AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM docs),
lengths AS (SELECT r, 100 - 75 + (75 * len(terms) * n_docs) // all_terms AS m FROM docs, sums),
postings AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sums),
scores AS (
  SELECT uid, item_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY uid, item_id, r),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
  FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
