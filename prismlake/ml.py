"""The transforms and the classifier as pyspark.ml stages: they go into a Pipeline, and parameters can be
saved and loaded with it."""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake.functions import rowlocal as R
from prismlake.operators import diagnostics, latent, preprocess
from prismlake.operators.gram import channels


class _Column(Params):
    """The array column that a stage works on."""

    column = Param(Params._dummy(), "column", "array column of channels", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(column="x")


class Snv(Transformer, _Column, DefaultParamsReadable, DefaultParamsWritable):
    """Standard normal variate of each row."""

    @keyword_only
    def __init__(self, *, column: str = "x"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.getOrDefault("column")
        return dataset.withColumn(c, R.snv(F.col(c)))


class SavGol(Transformer, _Column, DefaultParamsReadable, DefaultParamsWritable):
    """Savitzky-Golay filter along the channels."""

    window = Param(Params._dummy(), "window", "odd number of channels", TypeConverters.toInt)
    poly = Param(Params._dummy(), "poly", "degree", TypeConverters.toInt)
    deriv = Param(Params._dummy(), "deriv", "derivative", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, column: str = "x", window: int = 25, poly: int = 2, deriv: int = 1):
        super().__init__()
        self._setDefault(window=25, poly=2, deriv=1)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.getOrDefault("column")
        return dataset.withColumn(c, R.savgol(F.col(c), *(self.getOrDefault(k) for k in ("window", "poly", "deriv"))))


class Msc(Estimator, _Column, DefaultParamsReadable, DefaultParamsWritable):
    """Scatter correction against the mean of the rows it is fitted on."""

    @keyword_only
    def __init__(self, *, column: str = "x"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MscModel:
        c = self.getOrDefault("column")
        mean, _ = preprocess.column_moments(dataset.select(F.col(c).alias("x")))
        return MscModel(column=c, reference=[float(v) for v in mean])


class MscModel(Model, _Column, DefaultParamsReadable, DefaultParamsWritable):
    reference = Param(Params._dummy(), "reference", "reference spectrum", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, column: str = "x", reference: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.getOrDefault("column")
        return dataset.withColumn(c, R.msc(F.col(c), R.constants(np.array(self.getOrDefault("reference")))))


class PlsDa(Estimator, _Column, DefaultParamsReadable, DefaultParamsWritable):
    """PLS-DA: label in, predicted class and softmax shares out."""

    components = Param(Params._dummy(), "components", "latent variables", TypeConverters.toInt)
    label = Param(Params._dummy(), "label", "class column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column: str = "x", label: str = "label", components: int = 3):
        super().__init__()
        self._setDefault(label="label", components=3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PlsDaModel:
        rows, classes = latent.with_targets(dataset.select(F.col(self.getOrDefault("column")).alias("x"), F.col(self.getOrDefault("label")).cast("string").alias("label")).where("label is not null"))
        p = channels(rows)
        m = diagnostics.whole(rows, F.col("y"))
        a = min(self.getOrDefault("components"), p, int(m.n) - 1)
        model = latent.fit_pls(m, p, a)
        b = model.coefficients(model.w.shape[1])
        return PlsDaModel(column=self.getOrDefault("column"), weights=json.dumps({"classes": classes, "b": b.tolist(), "offset": (model.y_mean - model.x_mean @ b).tolist()}))


class PlsDaModel(Model, _Column, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "classes, coefficients and offsets as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column: str = "x", weights: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = json.loads(self.getOrDefault("weights"))
        b, x = np.array(w["b"]), F.col(self.getOrDefault("column"))
        scores = R.products(x, b, np.array(w["offset"]))
        out = dataset.withColumn("scores", scores)
        return out.withColumn("predicted", latent.predicted_class("scores", w["classes"])).withColumn("probability", R.softmax(F.col("scores")))
