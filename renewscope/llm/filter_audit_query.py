"""Query of the filter audit and the SQL that must give the same rows."""

from renewscope.llm.common import table
from renewscope.llm.filter_audit import audit, failure_masks


def op13_filter_audit(spark, sf_dir):
    """Counts of every step of all 120 orders of the filters, for every source."""
    return audit(failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH body AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM body GROUP BY body
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 5 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(doc_id > first_id, false) AS e
  FROM body JOIN firsts USING (body) LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
    || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM fails GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
  SELECT part, n, good, toxic, filter_order, step, letter, contains(failed, letter) AS fails, failed = letter AS alone,
    translate(failed, before, '') != failed AS gone FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM told GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": SQL}
