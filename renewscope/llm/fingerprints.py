"""Fingerprints of documents as sums of paragraph vectors; DataFrame functions only.

A paragraph (a line that isn't empty) is hashed with SHA-256 to a vector of 256 lanes that are 0 or 1. A
document's fingerprint is the sum of its paragraphs' vectors and their number, each lane modulo 2 ** 32: equal
multisets of paragraphs have equal sums in whatever order, a paragraph is inserted or deleted by adding or
subtracting its vector, and fingerprints of parts add up to that of the whole. Lanes as signs (+1, -1)
give the scalar product of two multisets, from which their likeness is estimated.

A fingerprint is an array of 128 longs with two lanes each and a last one with the number of paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewscope.session import through_table

LANES, WORDS = 256, 128
_LANE, _BOTH = (1 << 32) - 1, (1 << 32) + 1


def paragraphs(text: Column) -> Column:
    """The lines of a text that aren't empty; a null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def fingerprint(pieces: Column) -> Column:
    """The fingerprint of an array of paragraphs.

    SHA-256 gives four longs a paragraph; bits k and k + 32 of a long are one word's two lanes, so a
    word of the sum takes one shift and one mask a paragraph. Lanes can't run over: a string has
    fewer than 2 ** 31 bytes."""
    hashed = F.transform(pieces, lambda p: F.sha2(p, 256))
    number = lambda j: F.transform(hashed, lambda h: F.conv(F.substring(h, 16 * j + 1, 16), 16, -10).cast("long"))
    told = F.struct(*[number(j).alias(f"h{j}") for j in range(4)], F.array(F.size(pieces).cast("long")).alias("n"))
    zero = F.lit(0).cast("long")
    shifted = lambda h, k: F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_BOTH))
    lanes = lambda t, j: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(t[f"h{j}"], zero, lambda s, h: s + shifted(h, k)))
    # Through an array of one element, so that the hashes are found once.
    return F.transform(F.array(told), lambda t: F.concat(*[lanes(t, j) for j in range(4)], t["n"]))[0]


def _lanewise(a: Column, b: Column, op) -> Column:
    low = lambda x: x.bitwiseAND(F.lit(_LANE))
    high = lambda x: F.shiftrightunsigned(x, 32)
    return F.zip_with(a, b, lambda x, y: F.shiftleft(op(high(x), high(y)), 32).bitwiseOR(low(op(low(x), low(y)))))


def inserted(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs and b's together."""
    return _lanewise(a, b, lambda x, y: x + y)


def deleted(a: Column, b: Column) -> Column:
    """The fingerprint of a's paragraphs without b's; insertions may as well follow later."""
    return _lanewise(a, b, lambda x, y: x - y)


def product(a: Column, b: Column) -> Column:
    """Scalar product of two fingerprints' lanes taken as signs, in doubles: 256 times the number of
    equal pairs of paragraphs, give or take what differing ones add by chance."""
    n, m = F.element_at(a, -1), F.element_at(b, -1)
    low = lambda x: x.bitwiseAND(F.lit(_LANE))
    high = lambda x: F.shiftrightunsigned(x, 32)
    of = lambda x, y: (2 * x - n).cast("double") * (2 * y - m)
    each = F.zip_with(F.slice(a, 1, WORDS), F.slice(b, 1, WORDS), lambda x, y: of(low(x), low(y)) + of(high(x), high(y)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x)


def likeness(ab: Column, aa: Column, bb: Column) -> Column:
    """Twice the common part over the sum of both, 0 to 1, from scalar products; two empty texts are alike."""
    return F.when(aa + bb == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * ab / (aa + bb))))


def digest(mark: Column) -> Column:
    """A fingerprint as 64 hexadecimal digits."""
    return F.sha2(F.array_join(mark, ","), 256)


def _neighbours(keys: DataFrame) -> DataFrame:
    """at, id, copies, n, next_at, lent_to, lent of every distinct (id, text), in descending order of the id.

    Keys are sorted by range and each range looks at its own rows; only the ends of the ranges, two rows
    each, meet in one window. Nulls come last; texts of one id are ordered by their digest."""
    order = [F.desc_nulls_last("id"), F.asc("at")]
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    placed = through_table(placed, "document-ranges")
    inside = Window.partitionBy("range").orderBy(*order)
    linked = placed.withColumns({"next_in": F.lead("at").over(inside), "back_in": F.lag("at").over(inside), "back_n": F.lag("n").over(inside)})
    linked = through_table(linked, "document-neighbours")
    # All ends in order: each range's first and last row.
    ends = linked.where("next_in IS NULL OR back_in IS NULL").select("range", "id", "at", "n")
    line = Window.orderBy("range", *order)
    whole = Window.orderBy("range", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("at").alias("end_at"),
                       F.coalesce(F.lead("at").over(line), F.first("at").over(whole)).alias("next_out"),
                       F.coalesce(F.lag("at").over(line), F.last("at").over(whole)).alias("back_out"),
                       F.coalesce(F.lag("n").over(line), F.last("n").over(whole)).alias("back_out_n"))
    met = linked.join(ends, F.col("at") == F.col("end_at"), "left")
    return met.select("id", "at", "copies", "n", F.coalesce("next_in", "next_out").alias("next_at"),
                      F.coalesce("back_in", "back_out").alias("lent_to"), F.coalesce("back_n", "back_out_n").alias("lent_n"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, edited, mark, edited_mark, near_edited, near_next of every document.

    The edited text has the last third replaced by the beginning of the next document, in descending order of
    the id and from the last one to the first. Its fingerprint is the document's own without the paragraphs from
    the cut on and with those that stand there now.

    A null text is empty. A null id comes after all others, and texts of one id follow each other by digest. Rows
    that are equal in id and text follow each other: all but the last are edited with their own text. They
    are worked out once, however many they are. One document alone is its own next. Other columns are not looked at;
    an empty table gives no rows. Texts move once by their own key, and once, cut to what is needed, to the document before.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), body.alias("body"))
    rows = rows.withColumn("at", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), "body")))
    keys = rows.select("id", "at", F.length("body").cast("long").alias("n")).groupBy("at").agg(
        F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    links = _neighbours(keys).withColumnRenamed("at", "link_at")
    texts = rows.groupBy("at").agg(F.first("body").alias("body"))
    own = texts.join(links, F.col("at") == F.col("link_at")).withColumn("mark", fingerprint(paragraphs(F.col("body"))))
    third = lambda n: F.floor(n / 3).cast("int")
    lent = own.select(F.col("lent_to").alias("to"), F.left("body", third(F.col("lent_n"))).alias("lent"), F.col("mark").alias("next_mark"))
    met = own.join(lent, F.col("at") == F.col("to"))
    itself = F.struct(F.left("body", third(F.col("n"))).alias("lent"), F.col("mark").alias("next_mark"), (F.col("copies") - 1).alias("times"))
    other = F.struct("lent", "next_mark", F.lit(1).cast("long").alias("times"))
    met = met.select("id", "n", "body", "mark", F.explode(F.when(F.col("copies") > 1, F.array(itself, other)).otherwise(F.array(other))).alias("way"))
    # Whole lines before the cut stay; what begins in the line of the cut is taken out and put in.
    kept = F.left("body", (F.col("n") - third(F.col("n"))).cast("int"))
    met = met.select("id", "n", "body", "mark", F.col("way.next_mark").alias("next_mark"), F.col("way.times").alias("times"), kept.alias("kept"), F.col("way.lent").alias("lent"))
    cut = (F.length("kept") - F.length(F.substring_index("kept", "\n", -1)) + 1).cast("int")
    met = met.withColumns({"edited": F.concat("kept", "lent"), "cut": cut})
    tail = lambda c: fingerprint(paragraphs(F.substring(F.col(c), F.col("cut"), F.length(c))))
    met = met.withColumn("edited_mark", inserted(deleted(F.col("mark"), tail("body")), tail("edited")))
    m, e, x = F.col("mark"), F.col("edited_mark"), F.col("next_mark")
    met = met.withColumns({"mm": product(m, m), "ee": product(e, e), "xx": product(x, x), "me": product(m, e), "mx": product(m, x)})
    c = F.col
    return met.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        c("id").alias("doc_id"), c("n").alias("n_chars"), c("body").alias("text"), "edited", "mark", "edited_mark",
        likeness(c("me"), c("mm"), c("ee")).alias("near_edited"), likeness(c("mx"), c("mm"), c("xx")).alias("near_next"))
