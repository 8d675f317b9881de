"""Query of the spelling variants and the SQL that must give the same rows."""

from renewscope.llm.common import table
from renewscope.llm.variants import FACTOR, LEAST_COUNT, LEAST_LENGTH, ONE_IN, counted_words, variant_forms


def op12_spelling_variants(spark, sf_dir):
    """Form, root and near words of every word of the corpus."""
    return variant_forms(counted_words(table(spark, sf_dir, "documents")))


#: CRC-32 bit by bit: the reflected polynomial 0xEDB88320, from the lowest bit of each byte on. Words one edit apart
#: are equal with the same letter left out (replaced), or one is the other with a letter left out.
SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS name, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]{{{LEAST_LENGTH},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (
  SELECT run, count(*) AS times, hex(name || ':' || run) AS bytes FROM runs GROUP BY name, run
), hashed AS (
  SELECT run, times, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten([[(('0x' || bytes[2 * i - 1:2 * i])::UBIGINT >> j::UBIGINT) & 1 FOR j IN range(8)] FOR i IN range(1, len(bytes) // 2 + 1)])),
    lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))), 4294967295::UBIGINT) AS h FROM counted
), words AS (
  SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY word HAVING length(word) >= {LEAST_LENGTH} AND sum(times) >= {LEAST_COUNT}
), less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, generate_series(1, length(word)) AS s(i)
), near AS (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT a, count(*) AS n_near, max(n) AS most FROM near GROUP BY a
), forms AS (
  SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FACTOR} * words.n THEN (SELECT min(b) FROM near WHERE near.a = word AND near.n = most) END AS form,
    CASE WHEN most >= {FACTOR} * words.n THEN most END AS form_n
  FROM words LEFT JOIN best ON a = word
), walks AS (
  SELECT word, word AS root, form AS ahead FROM forms
  UNION ALL
  SELECT walks.word, forms.word, forms.form FROM walks JOIN forms ON forms.word = walks.ahead
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN (SELECT word, root FROM walks WHERE ahead IS NULL) USING (word)
"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLES = {"op12_spelling_variants": SQL}
