"""Joins with a table of unique keys of which a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than a HOT-th of the rows is hot, so there are at most HOT hot keys and they can be broadcast.
HOT = 2_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left.join(right, keys, "left"), for a right side that has each key at most once.

    Rows of hot keys meet a broadcast of those keys' rows and stay where they are; all others are dealt by
    their keys, of which none has more than a HOT-th of the rows. left should be a stored table, as it is read
    for the counts too. Null keys find nothing; empty sides are allowed."""
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = counts.where(F.col("_n") > total / HOT).select(*keys, F.lit(True).alias("_hot"))
    some = right.join(F.broadcast(hot), keys)
    marked = left.join(F.broadcast(some.select(*keys, "_hot", F.struct(*[c for c in right.columns if c not in keys]).alias("_found"))), keys, "left")
    found = [c for c in right.columns if c not in keys]
    quick = marked.where("_hot").select(*left.columns, *(F.col("_found")[c].alias(c) for c in found))
    slow = marked.where("_hot is null").select(*left.columns).join(right, keys, "left").select(*left.columns, *found)
    return quick.unionAll(slow)
