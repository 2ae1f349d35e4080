"""Input validation: what is wrong with a set of spectra, as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.schema import to_long


def drop_nonfinite(spectra: DataFrame) -> DataFrame:
    return spectra.where(R.finite(F.col("x")))


def constant_columns(spectra: DataFrame, floor: float = 1e-12) -> DataFrame:
    return to_long(spectra.select("x")).groupBy("j").agg(F.var_pop("v").alias("variance")).select("j", (F.col("variance") <= floor).alias("constant"))


def exact_duplicates(spectra: DataFrame) -> DataFrame:
    """Rows, distinct rows and copies; rows are compared by all their values."""
    n = spectra.groupBy("x").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_copies"))


#: Projections that pairs are first compared by, and those of them whose cells bring pairs together.
DIRECTIONS, CELLS = 16, 4


def near_duplicates(spectra: DataFrame, least: float = 0.99995) -> DataFrame:
    """Pairs a < b with a correlation above `least`, over all rows with x.

    Unit rows of that correlation are less than sqrt(2 - 2 least) apart, and so are their projections on any
    orthonormal directions, taken together. The directions in which the unit rows vary most are taken: along
    them, rows that differ differ most. One side stands in its cell of a grid over the first few, the other in all
    cells that this distance reaches: no pair is missed, and each meets in one cell. Only numbers and projections
    meet there; the rows themselves are joined to the pairs whose projections are close enough."""
    from prismlake.operators.diagnostics import whole
    from prismlake.operators.latent import fit_pca

    rows = spectra.where("x is not null").select("sample_id", R.l2_normalize(R.snv(F.col("x"))).alias("x"))
    first = rows.select(F.size("x").alias("p")).first()
    if first is None:
        return spectra.sparkSession.createDataFrame([], "a long, b long, r double")
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    axes = fit_pca(whole(rows), first["p"], DIRECTIONS).loadings.T
    cells = [f"c{k}" for k in range(min(CELLS, len(axes)))]
    u = rows.select("sample_id", R.bound(F.col("x"), lambda v: F.array(*(R.dot(v, R.constants(d)) for d in axes))).alias("p"))
    at = lambda k: F.get("p", F.lit(k)) / (2 * reach)
    a = u.select(F.col("sample_id").alias("a"), F.col("p").alias("pa"), *(F.floor(at(k)).alias(c) for k, c in enumerate(cells)))
    b = u.select(F.col("sample_id").alias("b"), "p")
    for k, c in enumerate(cells):
        b = b.withColumn(c, F.explode(F.array_distinct(F.array(F.floor(at(k) - 0.5), F.floor(at(k) + 0.5)))))
    apart = R.total(F.zip_with("pa", "p", lambda v, w: (v - w) * (v - w)))
    close = a.join(b, cells).where("a < b").where(apart <= reach * reach).select("a", "b")
    sides = close.join(rows.select(F.col("sample_id").alias("a"), F.col("x").alias("xa")), "a").join(rows.select(F.col("sample_id").alias("b"), F.col("x").alias("xb")), "b")
    return sides.select("a", "b", R.dot(F.col("xa"), F.col("xb")).alias("r")).where(F.col("r") > least)


def class_balance(spectra: DataFrame, worst: float = 5.0) -> DataFrame:
    c = spectra.groupBy("label").count()
    return c.agg(F.count("*").alias("n_classes"), F.min("count").alias("least"), F.max("count").alias("most"), (F.max("count") / F.min("count")).alias("ratio"), (F.max("count") / F.min("count") > worst).alias("unbalanced"))


def dominant_range(ranges: DataFrame, end: str = "x_max", tolerance: float = 50.0) -> DataFrame:
    """Rows whose range end lies within the tolerance of the commonest end rounded to hundreds (half to
    even; of equally common ones the lowest)."""
    key = F.bround(F.col(end) / 100, 0) * 100
    mode = ranges.groupBy(key.alias("mode")).count().orderBy(F.desc("count"), "mode").limit(1).select("mode")
    return ranges.withColumn("range_key", key).crossJoin(F.broadcast(mode)).withColumn("kept", F.abs(F.col("range_key") - F.col("mode")) < tolerance)
