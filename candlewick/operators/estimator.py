"""Least squares as a Spark ML estimator: fitted models can be saved, loaded by a
later job, put into pipelines and cross-validated."""

from __future__ import annotations

from functools import reduce
from operator import add, mul

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.functions.least_squares import monomials, solve_factor
from candlewick.operators.models import _pooled_factors


class _LeastSquaresParams(HasLabelCol, HasPredictionCol):
    degree = Param(Params._dummy(), "degree", "highest degree of the monomials", TypeConverters.toInt)
    featureCols = Param(Params._dummy(), "featureCols", "columns to learn from", TypeConverters.toListString)

    def __init__(self):
        super().__init__()
        self._setDefault(degree=1, featureCols=list(MODEL_FEATURES), labelCol="close", predictionCol="prediction")

    def getDegree(self) -> int:
        return self.getOrDefault(self.degree)

    def getFeatureCols(self) -> list[str]:
        return self.getOrDefault(self.featureCols)


class LeastSquaresRegressor(Estimator, _LeastSquaresParams, DefaultParamsReadable, DefaultParamsWritable):
    """Polynomial least squares by mergeable triangular factors.

    Columns are standardised first; rows with a null feature or label are left out.
    A fit takes two passes over the rows; one factor, as wide as the terms, comes to
    the driver.  Terms that others determine get the solution of least length.
    """

    @keyword_only
    def __init__(self, *, degree=1, featureCols=MODEL_FEATURES, labelCol="close", predictionCol="prediction"):
        super().__init__()
        self._set(degree=degree, featureCols=list(featureCols), labelCol=labelCol, predictionCol=predictionCol)

    def setDegree(self, value: int) -> LeastSquaresRegressor:
        return self._set(degree=value)

    def _fit(self, dataset: DataFrame) -> LeastSquaresModel:
        features, label, degree = self.getFeatureCols(), self.getLabelCol(), self.getDegree()
        names = [*features, label]
        rows = dataset.select(*names).dropna()
        measured = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(c) for c in names]).alias("means"),
            F.array(*[F.stddev_samp(c) for c in names]).alias("spreads"),
        ).first()
        if not measured["n"]:
            raise ValueError("no complete row to learn from")
        pooled, _, _ = _pooled_factors(rows, degree, features, label, F.lit(0))
        terms = len(monomials(len(features), degree))
        factor = np.array(pooled.first()["factor"]).reshape(1, terms + 1, terms + 1)
        beta = solve_factor(factor, terms)[0]
        spreads = [s if s is not None and s > 0 else 1.0 for s in measured["spreads"]]
        model = LeastSquaresModel()
        model._set(
            degree=degree, featureCols=features, labelCol=label, predictionCol=self.getPredictionCol(),
            coefficients=beta.tolist(), means=measured["means"], spreads=spreads,
        )
        return model._resetUid(self.uid)


class LeastSquaresModel(Model, _LeastSquaresParams, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted polynomial; its numbers are parameters, so they are saved with it."""

    coefficients = Param(Params._dummy(), "coefficients", "of the standardised terms", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "of the features and the label", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "of the features and the label", TypeConverters.toListFloat)

    def prediction(self) -> Column:
        """The polynomial as one expression; null where a feature is null."""
        means, spreads = self.getOrDefault(self.means), self.getOrDefault(self.spreads)
        features = self.getFeatureCols()
        scaled = [(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(features, means, spreads)]
        products = []
        for beta, powers in zip(self.getOrDefault(self.coefficients), monomials(len(features), self.getDegree()), strict=True):
            factors = [z for z, p in zip(scaled, powers, strict=True) for _ in range(p)]
            products.append(reduce(mul, factors, F.lit(beta)))
        total = reduce(add, products)
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
        return F.when(known, F.lit(means[-1]) + F.lit(spreads[-1]) * total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self.prediction())

    def score(self, dataset: DataFrame) -> float:
        """R2 of the predictions on the rows with a label and all features."""
        y = F.col(self.getLabelCol())
        rows = dataset.withColumn("__p", self.prediction()).where(y.isNotNull() & F.col("__p").isNotNull())
        got = rows.agg(F.avg((y - F.col("__p")) ** 2).alias("mse"), F.var_pop(y).alias("spread")).first()
        return 1 - got["mse"] / got["spread"] if got["spread"] else float("nan")
