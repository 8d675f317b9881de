"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least this share of the rows. At most
# 1 / HOT_SHARE keys can be hot, whatever the size of the data, so a table
# of hot keys has a proven bound and may be broadcast.
HOT_SHARE = 0.002


def hot_keys(counted: DataFrame, keys: Sequence[str], weight: str,
             share: float = HOT_SHARE) -> DataFrame:
    """Keys whose weight is at least `share` of the total weight.

    `counted` has one row per key; the result has at most 1 / share rows.
    """
    total = counted.agg(F.sum(weight)).scalar()
    return counted.where(F.col(weight) >= F.greatest(total * F.lit(share), F.lit(1))).select(
        *keys, weight
    )


def join_unique(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], weight: str,
                share: float = HOT_SHARE) -> DataFrame:
    """Inner join to a lookup that has one row per key and knows each key's weight.

    Rows of hot keys meet a broadcast of at most 1 / share lookup rows and are not
    shuffled at all; the others take the ordinary shuffled join.
    """
    hot = hot_keys(lookup, keys, weight, share).select(*keys)
    hot_lookup = lookup.join(F.broadcast(hot), list(keys), "left_semi")
    cold_lookup = lookup.join(F.broadcast(hot), list(keys), "left_anti")
    hot_part = facts.join(F.broadcast(hot_lookup), list(keys))
    cold_part = facts.join(F.broadcast(hot), list(keys), "left_anti").join(cold_lookup.hint("merge"), list(keys))
    return hot_part.unionByName(cold_part)
