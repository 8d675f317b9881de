"""Audit of filters that act one after another: what each filter removes in every order of the filters.

Each document is reduced to the mask of filters that it fails, and documents to counts per part and
mask, so that the orders are walked once a (part, mask) cell and never once a document. A cell folds
across the array of orders and gives one struct a step of each order, weighted by the cell's counts;
a part's structs are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewscope.llm.common import WORD

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = "[#$%&*|]"
#: What a step counts, in the order of the structs.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3 of the mask: the filters A to D that look at one text alone. A null text is empty."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    # One struct, so that the words of a text are found once.
    told = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    return F.transform(F.array(told), lambda t: (
        F.when(t["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * t["distinct"].cast("long") < LEAST_DISTINCT * t["n"].cast("long"), 2).otherwise(0)
        + F.when(100 * capitals.cast("long") > MOST_CAPITALS * F.length(body).cast("long"), 4).otherwise(0)
        + F.when(body.rlike(SYMBOLS), 8).otherwise(0)))[0]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every document; nothing of a text is kept but its digest.

    The last filter fails a text that a smaller id has, anywhere in the table. The smallest id of each
    digest is found by partial aggregation, and rows meet it by digest and id together: a group of
    copies spreads over tasks, however many rows it has. A null id is smaller than none and has none
    smaller; rows of equal id are no copies of each other. Several labels of an id count as one that
    says yes where any of them does. A null source is the empty part."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.md5(body)).alias("digest"), text_failures(F.col("text")).alias("bits"))
    firsts = rows.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first_id"))
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("known")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    told = rows.join(firsts, (F.col("id") == F.col("first_id")) & (F.col("digest") == F.col("of")), "left")
    told = told.join(known, F.col("id") == F.col("known"), "left")
    copied = F.when(F.col("id").isNotNull() & F.col("of").isNull(), 1 << 4).otherwise(0)
    return told.select("part", (F.col("bits") + copied).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def order_cells(masks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 2 ** filters cells a part."""
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _walk(order: str) -> str:
    """One order's steps for a cell: a fold that knows which bits have been met already.

    `met` has the failed bits of the steps before; the cell's documents are still there while it is 0."""
    counts = """named_struct(
        'kept', IF(s.met = 0 AND (mask & b) = 0, n, 0L), 'removed', IF(s.met = 0 AND (mask & b) != 0, n, 0L),
        'redundant', IF(s.met != 0 AND (mask & b) != 0, n, 0L), 'unique_fails', IF(mask = b, n, 0L),
        'good_lost', IF(s.met = 0 AND (mask & b) != 0, good, 0L), 'toxic_lost', IF(s.met = 0 AND (mask & b) != 0, toxic, 0L))"""
    none = "CAST(array() AS ARRAY<STRUCT<" + ", ".join(f"{c}: BIGINT" for c in COUNTS) + ">>)"
    return f"aggregate({order}, named_struct('met', 0, 'steps', {none}), (s, b) -> named_struct('met', s.met | (mask & b), 'steps', concat(s.steps, array({counts}))), s -> s.steps)"


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, for every part, order and step, and `shapley`: what
    the step's filter removes, summed over all orders.

    The orders are a constant array of the plan (120 for five filters); a part has at most 32 cells,
    so its arrays are gathered within a proven bound. No rows give no rows."""
    orders = ["".join(p) for p in permutations(filters)]
    bits = F.array(*[F.array(*[F.lit(1 << filters.index(c)) for c in o]) for o in orders])
    cells = order_cells(masks).withColumn("orders", bits)
    folded = cells.select("part", F.expr(f"flatten(transform(orders, o -> {_walk('o')}))").alias("steps"))
    add = "named_struct(" + ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS) + ")"
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = merged.select("part", F.expr(f"aggregate(slice(cells, 2, size(cells)), cells[0], (a, c) -> zip_with(a, c, (x, y) -> {add}))").alias("steps"))
    names, n = F.array(*[F.lit(o) for o in orders]), len(filters)
    letter = lambda at: F.substring(F.get(names, F.floor(at / n).cast("int")), (at % n + 1).cast("int"), F.lit(1))
    own = lambda c: F.filter("steps", lambda s, i: letter(i) == c)
    shapley = F.array(*[F.aggregate(own(c), F.lit(0).cast("long"), lambda a, s: a + s["removed"]) for c in filters])
    placed = merged.withColumn("shapley", shapley).select("part", "shapley", F.posexplode("steps").alias("at", "c"))
    return placed.select(
        "part", F.get(names, F.floor(F.col("at") / n).cast("int")).alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"),
        *[F.col("c")[c].alias(c) for c in COUNTS], F.get("shapley", F.position(letter(F.col("at")), F.lit(filters)) - 1).alias("shapley"))
