"""Query of the document fingerprints and the SQL that must give the same rows."""

from renewscope.llm.common import table
from renewscope.llm.fingerprints import WORDS, digest, edited_documents
from pyspark.sql import functions as F


def op11_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likeness."""
    found = edited_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digest(F.col("mark")).alias("fingerprint"),
        digest(F.col("edited_mark")).alias("edited_fingerprint"), "near_edited", "near_next")


def _mark(text: str) -> str:
    """Sums of the lines' 0-1 lanes, two in a word, and the number of lines."""
    hashes = f"[sha256(p) FOR p IN string_split({text}, chr(10)) IF p != '']"
    numbers = [f"[('0x' || substr(h, {16 * j + 1}, 16))::UBIGINT FOR h IN {hashes}]" for j in range(4)]
    words = [f"[coalesce(list_sum([(h >> k::UBIGINT) & 4294967297::UBIGINT FOR h IN {number}]), 0)::UBIGINT FOR k IN range(32)]" for number in numbers]
    return f"list_concat({', '.join(words)}, [len({hashes})::UBIGINT])"


def _product(a: str, b: str) -> str:
    sign = lambda v, i, part: f"(2 * (({v}[{i}] {part}) & 4294967295)::BIGINT - {v}[{WORDS + 1}]::BIGINT)::DOUBLE"
    each = " + ".join(f"{sign(a, 'i', p)} * {sign(b, 'i', p)}" for p in ("", ">> 32"))
    return f"list_sum([{each} FOR i IN range(1, {WORDS + 1})])"


def _near(ab: str, aa: str, bb: str) -> str:
    return f"CASE WHEN {aa} + {bb} = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * {ab} / ({aa} + {bb}))) END"


SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
    row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, ''))) AS place FROM documents
), placed AS (
  SELECT *, coalesce(lead(place) OVER (ORDER BY place), first(place) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_place FROM docs
), edits AS (
  SELECT a.doc_id, a.n, a.body, b.body AS next_body, left(a.body, (a.n - a.n // 3)::BIGINT) || left(b.body, (a.n // 3)::BIGINT) AS edited
  FROM placed a JOIN docs b ON a.next_place = b.place
), marks AS (
  SELECT doc_id, n, edited, {_mark("body")} AS m, {_mark("edited")} AS e, {_mark("next_body")} AS x FROM edits
), products AS (
  SELECT *, {_product("m", "m")} AS mm, {_product("e", "e")} AS ee, {_product("x", "x")} AS xx, {_product("m", "e")} AS me, {_product("m", "x")} AS mx FROM marks
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(m, ',')) AS fingerprint,
  sha256(array_to_string(e, ',')) AS edited_fingerprint, {_near("me", "mm", "ee")} AS near_edited, {_near("mx", "mm", "xx")} AS near_next
FROM products
"""

QUERIES = {"op11_fingerprints": op11_fingerprints}
ORACLES = {"op11_fingerprints": SQL}
