"""Mixing sources to target weights by Pareto order sampling.

A document's share of its source's target is its weight times a constant of the source, and stops
at `cap`: the whole part is a number of certain copies, the rest is its inclusion probability.
The constant is the one that makes the expected words the target. Documents are ranked by their random
odds divided by their inclusion odds (Pareto order sampling) and taken in that order until
the words still missing are reached, so the number of words taken is fixed, not random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewscope.llm.common import WORD, fresh
from renewscope.session import through_table

#: Rank buckets of one level; each level cuts the bucket that holds a source's limit again.
BUCKETS = 1024
#: Weights are whole numbers up to this one, so that a source's constant is found from so many sums.
MOST_WEIGHT = 64
#: Bits of a row's serial number below the number of its part of the written table.
_PART = 33


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*key: Column) -> Column:
    """A number inside (0, 1), the same in every run: 52 bits of md5 of the key."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target of each source from rows (source, size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 ...; the sum of all sizes is
    shared by weight. A target stops at `cap` times its source's size and the excess goes to
    the others by weight: with sources in order of cap * size / weight, the first ones are
    capped and the rest get the same amount per unit of weight. One row per source is all
    that the two unpartitioned windows see.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    by_room = Window.orderBy(F.col("source_size") * F.lit(cap) / F.col("w"), F.col("source").asc_nulls_last())
    before, everyone = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.lit(cap) * F.col("size_before")) / F.col("w_left"))
        .withColumn("room", F.lit(cap) * F.col("source_size") / F.col("w"))
    )
    # The level that holds is that of the first source that it doesn't fill.
    first = F.min(F.when(F.col("room") >= F.col("level"), F.struct("room", "source", "level"))).over(everyone)
    per = per.withColumn("held", first["level"])
    target = F.when(F.col("held").isNull() | (F.col("room") <= F.col("held")), F.lit(cap) * F.col("source_size")).otherwise(F.col("held") * F.col("w"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def constants(sized: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, target, constant: the number that times a document's weight, `cap` at most, gives its
    expected copies, so that the source's expected words are its target. Weights that reach the cap are the
    largest ones: going down the weights, the constant is that of the first one that it doesn't
    bring above the cap. It is infinite if all are capped, and 0 for a source without words.

    Windows see a row for each weight of a source, MOST_WEIGHT at most."""
    per = _meet(sized.groupBy("source", "odds").agg(F.sum("size").cast("long").alias("words")), targets, "source")
    order = Window.partitionBy("source").orderBy(F.desc("odds"))
    whole, before = Window.partitionBy("source"), order.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.col("odds") * F.col("words")
    per = per.withColumn("all", F.sum(odd).over(whole)).withColumn("left", F.col("all") - F.coalesce(F.sum(odd).over(before), F.lit(0)))
    per = per.withColumn("c", F.when(F.col("left") > 0, (F.col("target") - F.lit(cap) * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.col("left")))
    held = F.max(F.when(F.col("c") * F.col("odds") <= F.lit(cap), F.struct("odds", "c")))["c"]
    found = per.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("all").alias("all"), held.alias("c"))
    constant = F.when(F.col("all") > 0, F.coalesce("c", F.lit(float("inf")))).otherwise(F.lit(0.0))
    return found.select("source", "source_size", "target", constant.alias("constant"))


def source_plan(sized: DataFrame, cap: float = 3.0) -> DataFrame:
    """Per source: size, target, constant, and the row at which its ranking is cut.

    A third of all rows may share one source: the cut is found by summing words per (source,
    rank bucket) in two levels, then by a running sum inside the one bucket of a source that
    holds the cut, about one row in a million. Only sums per source and bucket are gathered. Rows that
    are equal in rank, size and id are one row with a count there; how many of them still fit is
    worked out, and these are the first ones by their place in the written table, found by
    counts per part and then inside one part.
    """
    plan = through_table(constants(sized, source_targets(sized.select("source", "size"), cap), cap), "mix-targets")
    rows = _ranked(sized, plan, cap)
    sums = rows.groupBy("source", "bucket").agg(
        F.sum(F.when(F.col("pi") > 0, F.col("size")).otherwise(0)).alias("words"),
        F.sum(F.col("whole") * F.col("size")).alias("certain"))
    sums = through_table(sums.withColumn("coarse", F.floor(F.col("bucket") / BUCKETS)), "mix-sums")
    coarse = sums.groupBy("source", "coarse").agg(F.sum("words").alias("words"), F.sum("certain").alias("certain"))
    run = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select(
        "source", "coarse", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"),
        F.sum("certain").over(Window.partitionBy("source")).alias("certain"))
    fine = _meet(sums.select("source", "coarse", "bucket", "words"), coarse, "source", "coarse")
    fine = _meet(fine, plan.select("source", "target"), "source").withColumn("missing", F.col("target") - F.col("certain"))
    run = Window.partitionBy("source", "coarse").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    cuts = fine.where((F.col("words") > 0) & (F.col("before") < F.col("missing"))).groupBy("source").agg(
        F.max(F.struct("bucket", "before", "missing")).alias("x"))
    cuts = through_table(cuts.select("source", "x.*"), "mix-cuts")
    edge = _meet(rows.where(F.col("pi") > 0), cuts.select("source", F.col("bucket").alias("cut"), "before", "missing"), "source")
    ties = edge.where(F.col("bucket") == F.col("cut")).groupBy("source", "rank", "size", "doc_id", "before", "missing").agg(F.count("*").alias("n"))
    run = Window.partitionBy("source").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("so_far", F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0)))
    fits = lambda j: F.col("so_far") + (j - 1) * F.col("size") + F.col("size") / 2 <= F.col("missing")
    about = F.when(F.col("size") > 0, F.floor((F.col("missing") - F.col("so_far")) / F.col("size") + F.lit(0.5))).otherwise(F.col("n")).cast("long")
    fit = F.when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1)
    last = ties.withColumn("fit", F.least(F.col("n"), fit)).where(fits(F.lit(1))).groupBy("source").agg(
        F.max(F.struct("rank", "size", "doc_id", "fit")).alias("last")).select("source", "last.*")
    last = through_table(last, "mix-last")
    # The last one of the rows of a tie that fit.
    tie = last.select("source", *[F.col(c).alias(f"last_{c}") for c in ("rank", "size", "doc_id", "fit")])
    tied = _meet(rows.where(F.col("pi") > 0), tie, "source").where(
        (F.col("rank") == F.col("last_rank")) & (F.col("size") == F.col("last_size")) & F.col("doc_id").eqNullSafe(F.col("last_doc_id")))
    tied = through_table(tied.select("source", "serial", F.shiftright("serial", _PART).alias("part"), "last_fit"), "mix-tied")
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tied.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(run), F.lit(0)))
    inside = _meet(tied, parts, "source", "part").where((F.col("earlier") < F.col("last_fit")) & (F.col("last_fit") <= F.col("earlier") + F.col("n")))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("serial"))
    ends = inside.withColumn("place", place + F.col("earlier")).where(F.col("place") == F.col("last_fit")).select("source", "serial")
    last = _meet(last, ends, "source").select("source", F.struct("rank", "size", "doc_id", "serial").alias("last"))
    plan = _meet(plan, cuts.select("source", F.col("bucket").alias("cut")), "source", how="left")
    return through_table(_meet(plan, last, "source", how="left"), "mix-plan")


def _meet(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _ranked(rows: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """Rows (doc_id, source, size, odds, ...) with whole copies, inclusion probability and rank.

    The rank is the random odds over the inclusion odds, mapped into [0, 1] in the same order.
    The plan has one row per source; Spark broadcasts it if it is small, else splits hot sources."""
    ratio = F.when(F.col("odds") > 0, F.least(F.lit(cap), F.col("constant") * F.col("odds"))).otherwise(F.lit(0.0))
    u = uniform(F.col("doc_id"))
    q = (u / (F.lit(1.0) - u)) / (F.col("pi") / (F.lit(1.0) - F.col("pi")))
    return (
        _meet(rows, plan, "source", how="left").withColumn("ratio", ratio)
        .withColumn("whole", F.floor("ratio").cast("long")).withColumn("pi", F.col("ratio") - F.col("whole"))
        .withColumn("rank", F.when(F.col("pi") > 0, q / (F.lit(1.0) + q)).otherwise(F.lit(1.0)))
        .withColumn("bucket", F.least(F.floor(F.col("rank") * BUCKETS * BUCKETS), F.lit(BUCKETS * BUCKETS - 1)).cast("long"))
    )


def pareto_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cap: float = 3.0,
               weight: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document.

    `weight`: a column of relative inclusion odds inside a source, rounded up to a whole number, MOST_WEIGHT
    at most (null or below zero: 0, never taken); without it the odds are the number of binary
    digits of the document's size, so that longer documents are likelier. `keep`: the input's
    rows come along as a struct column `document`.

    Null or empty texts have size 0 and are taken for 0 words; null sources are one source;
    rows repeated in the table are documents of their own, with the same random number; ties
    of rank go to the smaller size, then to the smaller id, then to the earlier row. An empty table gives none. Other
    columns of the input are not looked at.
    """
    size = word_count(F.col(text))
    given = F.least(F.greatest(F.coalesce(F.ceil(F.col(weight).cast("double")), F.lit(0)), F.lit(0)), F.lit(MOST_WEIGHT)) if weight else F.length(F.bin(size))
    columns = [F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), given.cast("long").alias("odds")]
    document = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if keep else []
    # Rows of the written table have a number that stays the same in all readings.
    sized = through_table(docs.select(*columns, *document).withColumn("serial", F.monotonically_increasing_id()), "mix-sizes")
    plan = source_plan(sized.drop("document"), cap)
    rows = _ranked(sized, plan, cap)
    here = F.struct("rank", "size", "doc_id", "serial") <= F.col("last")
    one = (F.col("pi") > 0) & ((F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & here))
    copies = F.col("whole") + F.coalesce(one, F.lit(False)).cast("long")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(["document"] if keep else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns."""
    mix = pareto_mix(docs, keep=True, **options).where(F.col("copies") >= 1)
    each = mix.select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select("document.*")
