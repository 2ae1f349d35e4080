"""The data model: `spectra(sample_id, label, conc, group_id, x)` with x an array column, an `axis(j, wn)`
table, and the long form `(sample_id, label, group_id, conc, j, v)` for anything checked cell by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embeddings_as_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as spectra: triplicates share a group within their label, concentration by group."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    third = F.expr("vec_id div 3")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.col("label").cast("string").alias("label"),
        (third % 9 * 5).cast("double").alias("conc"),
        F.concat(F.col("label").cast("string"), F.lit("-"), third.cast("string")).alias("group_id"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def axis(spark: SparkSession, p: int, start: float = 4000.0, step: float = 10.0) -> DataFrame:
    return spark.range(p).select(F.col("id").cast("int").alias("j"), (F.lit(start) + step * F.col("id")).alias("wn"))


def to_long(spectra: DataFrame, column: str = "x") -> DataFrame:
    rest = [c for c in spectra.columns if c != column]
    return spectra.select(*rest, F.posexplode(column).alias("j", "v"))


def to_array(long: DataFrame, *keys: str) -> DataFrame:
    """The long form back to arrays, ordered by j."""
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("x"))
