"""Neural regressor, Spark ML estimator, k-fold of pipelines in parallel."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.operators import models
from candlewick.operators.estimator import LeastSquaresModel, LeastSquaresRegressor
from candlewick.operators.features import model_matrix, rolling_features
from candlewick.operators.neural import (
    BLOCK,
    NeuralSpec,
    _standard_rows,
    in_sample_neural,
    kfold_neural,
    outputs,
    slopes,
    start_weights,
    trained,
)
from helpers import SCHEMA, random_prices


@pytest.fixture(scope="module")
def matrix(spark):
    prices = spark.createDataFrame(random_prices([160, 120]), SCHEMA)
    return model_matrix(rolling_features(prices)).persist()


def numbers(matrix):
    rows = matrix.collect()
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    return x, np.array([r["close"] for r in rows]), np.array([r["event_id"] % 5 for r in rows])


def test_slopes_are_those_of_the_error():
    made = np.random.default_rng(1)
    x, y = made.normal(size=(20, 3)), made.normal(size=20)
    w = start_weights(3, NeuralSpec(hidden=4))
    got = slopes(w, x, y)
    assert got[-1] == 20 and got[-2] == pytest.approx(((outputs(w, x) - y) ** 2).sum())
    for k in range(len(w)):
        high, low = w.copy(), w.copy()
        high[k] += 1e-6
        low[k] -= 1e-6
        step = (((outputs(high, x) - y) ** 2).sum() - ((outputs(low, x) - y) ** 2).sum()) / 4e-6
        assert got[k] == pytest.approx(step, abs=1e-4)


def test_neural_equals_a_local_trainer(matrix):
    spec = NeuralSpec(hidden=6, rounds=25)
    x, y, fold = numbers(matrix)
    z, unit = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1), y.std(ddof=1)
    t = (y - y.mean()) / unit
    w = trained(lambda w: slopes(w[0], z, t)[None], 1, 5, spec)[0]
    p = outputs(w, z) * unit + y.mean()
    got = in_sample_neural(matrix, spec=spec).first()
    assert got["strategy"] == "NeuralRegressor" and got["n"] == len(y)
    assert got["mse"] == pytest.approx(np.mean((y - p) ** 2), rel=1e-6)
    assert got["correlation"] == pytest.approx(np.corrcoef(y, p)[0, 1], rel=1e-6)
    assert got["r2"] == pytest.approx(1 - np.mean((y - p) ** 2) / np.var(y), rel=1e-6)
    errors, absolute = [], []
    for k in range(5):
        on = fold != k
        w = trained(lambda w: slopes(w[0], z[on], t[on])[None], 1, 5, spec)[0]
        p = outputs(w, z[~on]) * unit + y.mean()
        errors.append(np.mean((y[~on] - p) ** 2))
        absolute.append(np.mean(np.abs(y[~on] - p)))
    scored = kfold_neural(matrix, models.fold_of("event_id"), 5, spec=spec).first()
    assert scored["folds"] == 5 and scored["mse"] == pytest.approx(np.mean(errors), rel=1e-6)
    assert scored["mae"] == pytest.approx(np.mean(absolute), rel=1e-6)
    assert kfold_neural(matrix.limit(0), models.fold_of("event_id"), 5, spec=NeuralSpec(rounds=1)).collect() == []


def test_rounds_read_even_blocks(spark):
    # One series is one task's after the windows; every round would be that task's.
    n = 3 * BLOCK + 5
    rows = spark.range(n, numPartitions=1).select(
        (F.col("id") % 3).cast("int").alias("fold"), F.sin("id").alias("a"), F.cos("id").alias("b"), (F.col("id") % 7).alias("y")
    )
    blocks, unit = _standard_rows(rows, ("a", "b"), "y", F.col("fold"))
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    got = {}
    for r in blocks.collect():
        part = np.frombuffer(r["numbers"]).reshape(-1, 3)
        assert 0 < len(part) <= BLOCK
        got.setdefault(r["fold"], []).append(part)
    for k in range(3):
        i = np.arange(k, n, 3)
        want = (np.sin(i) - np.sin(np.arange(n)).mean()) / np.sin(np.arange(n)).std(ddof=1)
        assert np.sort(np.concatenate(got[k])[:, 0]) == pytest.approx(np.sort(want))
    assert unit.first()["unit"] == pytest.approx((np.arange(n) % 7).std(ddof=1))


def test_dealt_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    rows = spark.range(1001, numPartitions=1).select((F.col("id") % 500).alias("a"), F.lit(None).cast("string").alias("b"))
    got = models.dealt(rows)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) == 11 and max(sizes) < 200
    assert sorted(r["a"] for r in got.collect()) == sorted(i % 500 for i in range(1001))
    assert [r["a"] for r in models.dealt(rows).collect()] == [r["a"] for r in got.collect()]
    few = models.dealt(rows.limit(50))
    assert few.count() == 50


def test_neural_learns(matrix):
    assert in_sample_neural(matrix, spec=NeuralSpec(rounds=80)).first()["r2"] > 0.9


@pytest.mark.parametrize("degree", [1, 3])
def test_estimator_saves_and_loads(matrix, tmp_path, degree):
    x, y, _ = numbers(matrix)
    fitted = Pipeline(stages=[SQLTransformer(statement="SELECT * FROM __THIS__"), LeastSquaresRegressor(degree=degree)]).fit(matrix)
    fitted.save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(loaded.stages[1], LeastSquaresModel)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    terms = np.stack([np.prod(z ** np.array(p), axis=1) for p in models.monomials(5, degree)], axis=1)
    want = terms @ np.linalg.lstsq(terms, y, rcond=None)[0]
    got = [r["prediction"] for r in loaded.transform(matrix).collect()]
    assert got == pytest.approx(want.tolist(), rel=1e-5)
    assert loaded.stages[1].score(matrix) == pytest.approx(1 - np.mean((y - want) ** 2) / np.var(y), rel=1e-6)
    nulls = matrix.limit(3).withColumn("std_7d", F.lit(None).cast("double"))
    assert [r["prediction"] for r in loaded.transform(nulls).collect()] == [None] * 3
    with pytest.raises(ValueError):
        LeastSquaresRegressor().fit(nulls)


def test_estimator_in_cross_validation(matrix):
    regressor = LeastSquaresRegressor()
    grid = ParamGridBuilder().addGrid(regressor.degree, [1, 2]).build()
    tuned = CrossValidator(
        estimator=regressor, estimatorParamMaps=grid, numFolds=5, parallelism=2, foldCol="fold",
        evaluator=RegressionEvaluator(labelCol="close", metricName="mse"),
    ).fit(matrix.withColumn("fold", models.fold_of("event_id")))
    own = {r["degree"]: r["mse"] for r in models.kfold_polynomial(matrix, (1, 2), models.fold_of("event_id")).collect()}
    assert tuned.avgMetrics == pytest.approx([own[1], own[2]], rel=1e-6)


def test_parallel_folds_equal_single_fits(matrix):
    tree = models.tree_pipeline("DecisionTreeRegressor")
    got = models.kfold_pipeline(matrix, "tree", tree, models.fold_of("event_id")).first()
    rows = matrix.withColumn("fold", models.fold_of("event_id"))
    errors = []
    for k in range(5):
        fitted = tree.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))
        errors.append(fitted.agg(F.avg((F.col("close") - F.col("prediction")) ** 2)).first()[0])
    assert got["folds"] == 5 and got["mse"] == pytest.approx(np.mean(errors))
