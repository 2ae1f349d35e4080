"""Row numbers over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def by_number(value: Column, lowest: float, highest: float, buckets: int = BUCKETS) -> Column:
    """The bucket of a number between two bounds; buckets ascend with the number."""
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor((value - lowest) / max(highest - lowest, 1e-300) * buckets))).cast("int")


def by_hash(digest: Column) -> Column:
    """The bucket of a hexadecimal digest: its first three digits."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def numbered(rows: DataFrame, bucket: Column, *order: str | Column, name: str = "rank", keys: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number from 1 in the given order (within the keys). `bucket` must ascend with the
    order: rows are numbered within buckets, and counts of the buckets, a few thousand for each key, give
    what goes before. So no task orders more than a bucket."""
    placed = rows.withColumn("_bucket", bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = F.col("_bucket") == F.col("_b")
    for s in same:
        on = on & s
    return placed.withColumn("_own", own).join(offsets, on).withColumn(name, (F.col("_own") + F.col("_offset")).cast("long")).drop("_bucket", "_own", "_b", "_offset", *(f"_{k}" for k in keys))
