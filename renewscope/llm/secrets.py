"""Secret scans by corpus-wide ownership frequency; DataFrame functions only.

Every candidate's value is hashed and counted over the whole corpus: in how many
repositories (documents) and of how many owners (sources) it occurs. A value that few
owners hold looks like a live credential; one that is copied widely is an
example. The fixed patterns always give spans; other candidate tokens only when their
value is owner-specific.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.llm.common import fresh
from renewscope.session import through_table

#: Kinds in the order of the contract, with pattern, least length of the counted part and its group.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]{16,}", 16, 0))
#: Further candidates: long tokens that mix letters and digits and use many different characters.
TOKEN, TOKEN_DISTINCT = r"[A-Za-z0-9_-]{20,}", 10
OWNED = "owned"
NAMES = [k[0] for k in KINDS] + [OWNED]
#: A value is owner-specific if no more owners than these hold it, in however many documents.
MAX_OWNERS = 2
#: Every assignment holds one of these, whatever the case of its letters.
NAMED = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Matches of one text whose lengths are summed in one go.
_STEP = 256
_SALTS = 32
MASK = "<SECRET>"


def _looks_live(value: Column) -> Column:
    """A token with a letter and a digit, of many characters, that no fixed kind covers."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= TOKEN_DISTINCT
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("^[0-9a-f]+$") & ~value.rlike("^AKIA[A-Z0-9]+$") & varied


def _found(text: Column, pattern: str, group: int) -> Column:
    """(gap, length, part, hash) of each match: characters since the match before, its length,
    the length and hash of the counted part. Null where nothing matches, which one scan tells."""
    gaps = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    each = F.transform(each, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("length"), F.length(x["part"]).alias("part"),
        F.sha2(x["part"], 256).alias("hash"), _looks_live(x["part"]).alias("live")))
    # The text after the last match has a gap and nothing else.
    return F.when(text.rlike(pattern), F.filter(each, lambda x: x["length"].isNotNull()))


def _placed(found: Column, kind: int, least: int) -> Column:
    """Spans (start, kind, end, hash) of matches that are long enough.

    Ends are running sums, in steps of a fixed number of matches, so that a text with very
    many matches costs no square of their number."""
    moves = F.transform(found, lambda x: (x["gap"] + x["length"]).cast("long"))
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(moves) / _STEP).cast("int") - 1, F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    bases = F.aggregate(steps, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(moves, b * _STEP + 1, F.lit(_STEP))))))
    spans = F.transform(found, lambda x, i: F.struct(
        (F.get(bases, F.floor(i / _STEP).cast("int")) + total(F.slice(moves, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP + 1))).alias("end"),
        x["length"].alias("length"), x["part"].alias("part"), x["hash"].alias("hash"), x["live"].alias("live")))
    kept = F.filter(spans, lambda x: (x["part"] >= least) & (x["live"] if kind == len(KINDS) else F.lit(True)))
    kept = F.transform(kept, lambda x: F.struct((x["end"] - x["length"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["hash"].alias("hash")))
    return F.coalesce(kept, F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string>>"))


def find_candidates(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source") -> DataFrame:
    """repo, owner, spans of every row: all candidates by start, then kind. Written once, hashes only."""
    body = F.coalesce(F.col(text), F.lit(""))
    kinds = [*KINDS, (OWNED, TOKEN, 20, 0)]
    raw = docs.select(F.col(key).alias("repo"), F.col(owner).alias("owner"), *[_found(body, p, g).alias(n) for n, p, _, g in kinds])
    raw = through_table(raw, "secret-matches")
    placed = raw.select("repo", "owner", *[_placed(F.col(n), k, least).alias(n) for k, (n, _, least, _) in enumerate(kinds)])
    return through_table(placed.select("repo", "owner", F.array_sort(F.concat(*[F.col(n) for n, *_ in kinds])).alias("spans")), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners of every candidate value, from distinct (hash, owner, repository)."""
    pairs = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")).distinct()
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         max_owners: int = MAX_OWNERS) -> DataFrame:
    """repo, owner, spans, live of every row; `live` has the hashes of the row's values that are owner-specific.

    Null and empty texts have no spans; a null id or source counts as one of its own; rows that
    are repeated count once as a repository and each keep their spans; other columns are not
    looked at. Owners alone decide, as one owner may use its own credential in any number of documents. A value that a third of all rows hold is counted by partial sums, and its rows
    are salted before they meet the values that are owner-specific.
    """
    found = find_candidates(docs, text, key, owner)
    few = ownership(found).where(F.col("owners") <= max_owners)
    few = few.select(F.col("hash").alias("few"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("few_salt"))
    salt = F.pmod(F.xxhash64("repo", "owner"), F.lit(_SALTS)).cast("int")
    held = found.where(F.size("spans") > 0)
    pairs = held.select("repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"), salt.alias("salt")).distinct()
    live = pairs.join(few, (F.col("hash") == F.col("few")) & (F.col("salt") == F.col("few_salt")), "left_semi")
    live = live.groupBy(F.col("repo").alias("r"), F.col("owner").alias("o")).agg(F.array_sort(F.collect_set("hash")).alias("live"))
    joined = held.join(live, F.col("repo").eqNullSafe(F.col("r")) & F.col("owner").eqNullSafe(F.col("o")), "left")
    none = F.array().cast("array<string>")
    clean = found.where(F.size("spans") == 0).select("repo", "owner", "spans", none.alias("live"))
    return joined.select("repo", "owner", "spans", F.coalesce("live", none).alias("live")).unionByName(clean)


def shown(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(KINDS))


def reported_spans(spans: Column, live: Column) -> Column:
    """The fixed kinds' spans and those of owner-specific tokens."""
    return F.filter(spans, lambda s: (s["kind"] < len(KINDS)) | F.array_contains(live, s["hash"]))


def _hidden(text: Column, pattern: str, group: int, secret) -> Column:
    """The text with the counted part of every match that `secret` holds for replaced by a mark.

    Matches are those of the scan, whole and from left to right; the counted part ends the match."""
    gaps = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))
    name = lambda x: F.left(x["whole"], F.length(x["whole"]) - F.length(x["part"]))
    kept = lambda x: F.when(F.coalesce(secret(x["part"]), F.lit(False)), F.concat(name(x), F.lit(MASK))).otherwise(F.coalesce(x["whole"], F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.transform(each, lambda x: F.concat(x["gap"], kept(x))), "")).otherwise(text)


def masked_documents(docs: DataFrame, text: str = "text", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The documents with every secret replaced by a mark; no row is dropped.

    A value of few owners is owner-specific in however many documents they use it.

    Values of assignments go first: a token that meets one lies inside it. Then whole tokens
    that are owner-specific: fixed kinds that meet one of these lie inside it as well. Access keys
    and hex runs go last; a hex run that begins in the digits of a key goes with it.
    Texts without a name of an assignment are not searched for one. Masked texts are written once, with a mark on those that hold a
    further candidate: only these meet the scan's result, so the texts of all others are not shuffled. A null text
    stays null; `n_chars`, if there is one, is counted anew.
    """
    row, o, live, suspect = (fresh(docs, x) for x in ("repo", "owner", "live", "suspect"))
    body = F.col(text)
    # A value is masked and its name kept; a bounded pattern covers what stands behind shorter values.
    assign, least = ASSIGN.rpartition("(")[0], KINDS[0][2]
    hidden = _hidden(body, ASSIGN, KINDS[0][3], lambda part: F.length(part) >= least)
    hidden = F.regexp_replace(hidden, f"({assign})[A-Za-z0-9+/_.=-]{{{least},}}", f"$1{MASK}")
    named = reduce(or_, [F.lower(body).contains(n) for n in NAMED])
    masked = docs.withColumn(text, F.when(named, hidden).otherwise(body))
    tokens = F.filter(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), _looks_live)
    holds = F.coalesce(body.rlike(TOKEN), F.lit(False)) & F.coalesce(F.size(tokens) > 0, F.lit(False))
    masked = through_table(masked.withColumn(suspect, holds), "masked-assignments")
    found = scan(docs, text, max_owners=max_owners).where(F.size("live") > 0).select(F.col("repo").alias(row), F.col("owner").alias(o), F.col("live").alias(live))
    found = found.dropDuplicates([row, o])
    some = masked.where(F.col(suspect)).join(found, F.col("doc_id").eqNullSafe(F.col(row)) & F.col("source").eqNullSafe(F.col(o)), "left")
    owned = lambda token: _looks_live(token) & F.array_contains(F.col(live), F.sha2(token, 256))
    some = some.withColumn(text, F.when(F.col(live).isNull(), body).otherwise(_hidden(body, TOKEN, 0, owned))).drop(row, o, live)
    masked = masked.where(~F.col(suspect)).unionByName(some)
    key = "AKIA(?=[A-Z0-9]{14})(?:[A-Z0-9]*[A-Z])?(?:[0-9a-f]{16,}|[0-9]*)"
    masked = masked.withColumn(text, F.regexp_replace(body, f"{key}|[0-9a-f]{{16,}}", MASK))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length(body).cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])
