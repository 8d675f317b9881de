"""Query of the mixing operator and the SQL that must give the same rows."""

from renewscope.llm.common import table
from renewscope.llm.mixing import pareto_mix


def op2_mix_sources(spark, sf_dir):
    """Size, target and words taken of every document."""
    mix = pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM per
), ran AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS room,
    sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(source_size) OVER o, 0)::DOUBLE AS size_before,
    (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS w_left
  FROM weighed
  WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - 3.0::DOUBLE * size_before) / w_left AS level FROM ran
), held AS (
  SELECT level AS held FROM levels WHERE room >= level ORDER BY room, source ASC NULLS FIRST LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN room <= held THEN 3.0::DOUBLE * source_size ELSE held * w END AS target
  FROM levels CROSS JOIN held
), classes AS (
  SELECT source, len(bin(size))::BIGINT AS odds, sum(size)::BIGINT AS words FROM sized GROUP BY ALL
), remain AS (
  SELECT c.source, c.odds, t.target, coalesce(sum(words) OVER b, 0) AS before,
    sum(odds * words) OVER (PARTITION BY c.source) - coalesce(sum(odds * words) OVER b, 0) AS remaining,
    sum(odds * words) OVER (PARTITION BY c.source) AS every
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
  WINDOW b AS (PARTITION BY c.source ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tried AS (
  SELECT *, CASE WHEN remaining > 0 THEN (target - 3.0::DOUBLE * before::DOUBLE) / remaining::DOUBLE END AS c FROM remain
), constants AS (
  SELECT source, CASE WHEN max(every) > 0 THEN coalesce(arg_max(c, odds) FILTER (WHERE c * odds <= 3.0::DOUBLE), 'inf'::DOUBLE) ELSE 0.0::DOUBLE END AS c
  FROM tried GROUP BY source
), ratios AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    least(3.0::DOUBLE, c.c * len(bin(d.size))::DOUBLE) AS ratio,
    (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source JOIN constants c ON d.source IS NOT DISTINCT FROM c.source
), odds AS (
  SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS pi FROM ratios
), ranked AS (
  SELECT *, CASE WHEN pi > 0 THEN ((u / (1.0::DOUBLE - u)) / (pi / (1.0::DOUBLE - pi))) ELSE 1.0::DOUBLE END AS q FROM odds
), ordered AS (
  SELECT *, sum(whole * size) OVER (PARTITION BY source) AS certain,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY q / (1.0::DOUBLE + q), size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM ranked
), taken AS (
  SELECT *, whole + CASE WHEN pi > 0 AND so_far + size / 2.0::DOUBLE <= target - certain THEN 1 ELSE 0 END AS copies FROM ordered
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM taken
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {"op2_mix_sources": SQL}
