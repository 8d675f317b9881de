"""Query of the secret scan and the SQL that must give the same rows."""

from pyspark.sql import functions as F

from renewscope.llm.common import table
from renewscope.llm.secrets import ASSIGN, MAX_OWNERS, TOKEN, TOKEN_DISTINCT, base_spans, reported_spans, scan, shown


def op10_secret_scan(spark, sf_dir):
    """Counts and spans of secrets in every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = base_spans(F.col("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("repo").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(reported_spans(F.col("spans"), F.col("live"))).alias("spans"),
        F.size(F.filter(base, lambda s: F.array_contains(F.col("live"), s["hash"]))).cast("long").alias("n_base_live"))


def _kind(name: str, number: int, pattern: str, group: int, least: int, more: str = "true") -> str:
    return f"""
{name}_m AS (
  SELECT row, regexp_split_to_array(body, {pattern}) AS gaps, regexp_extract_all(body, {pattern}, 0) AS wholes,
    regexp_extract_all(body, {pattern}, {group}) AS parts FROM docs
), {name} AS (
  SELECT row, {number} AS kind, length(wholes[i]) + list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN wholes[1:i - 1]]), 0) AS stop,
    length(wholes[i]) AS n, parts[i] AS part
  FROM (SELECT *, unnest(generate_series(1, len(wholes))) AS i FROM {name}_m)
  WHERE length(parts[i]) >= {least} AND {more}
)"""


_Q = {"assign": "'" + ASSIGN.replace("'", "''") + "'", "access": "'AKIA[A-Z0-9]+'", "hex": "'[0-9a-f]+'", "owned": f"'{TOKEN}'"}
_LIVE = f"""regexp_matches(parts[i], '[0-9]') AND regexp_matches(parts[i], '[A-Za-z]') AND NOT regexp_full_match(parts[i], '[0-9a-f]+')
    AND NOT regexp_full_match(parts[i], 'AKIA[A-Z0-9]+') AND len(list_distinct(string_split(parts[i], ''))) >= {TOKEN_DISTINCT}"""

SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS body FROM documents
), {_kind("assign", 0, _Q["assign"], 2, 12)}, {_kind("access", 1, _Q["access"], 0, 18)}, {_kind("hex", 2, _Q["hex"], 0, 16)},
{_kind("owned", 3, _Q["owned"], 0, 20, _LIVE)}, spans AS (
  SELECT row, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop, part,
    CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END AS name
  FROM (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM owned)
), held AS (
  SELECT DISTINCT part, coalesce(source, chr(1)) AS owner, coalesce(doc_id::VARCHAR, chr(1)) AS repo FROM spans JOIN docs USING (row)
), live AS (
  SELECT part FROM held GROUP BY part HAVING count(DISTINCT owner) <= {MAX_OWNERS}
), told AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind < 3 AND live.part IS NOT NULL) AS n_base_live,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3 OR live.part IS NOT NULL) AS every
  FROM spans LEFT JOIN live USING (part) GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(n_base_live, 0) AS n_base_live
FROM docs LEFT JOIN told USING (row)
"""

QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES = {"op10_secret_scan": SQL}
