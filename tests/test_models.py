import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.functions.least_squares import (
    FactorSolver,
    add_rows,
    expand,
    expanding_predictions,
    monomials,
    reduced,
    solve_factor,
)
from candlewick.operators import models
from candlewick.operators.features import model_matrix, rolling_features
from candlewick.plans import workflows
from helpers import SCHEMA, random_prices, series


def test_terms():
    x = np.array([[2.0, 3.0, 5.0], [1.0, -2.0, 0.5]])
    terms = monomials(3, 4)
    assert len(terms) == 35 and terms[:4] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    want = np.stack([np.prod(x ** np.array(t), axis=1) for t in terms], axis=1)
    assert expand(x, terms).tolist() == want.tolist()


def test_exact_line_walk_forward(spark):
    # y = 2x on 1..5, the first three rows for training.
    x, y = np.arange(1.0, 6.0)[:, None], 2 * np.arange(1.0, 6.0)
    z = FactorSolver(1, 1).rows(x[:3], y[:3])
    data = spark.createDataFrame(
        [(reduced(z).ravel().tolist(), x[3:].tolist(), y[3:].tolist())],
        "g array<double>, x array<array<double>>, y array<double>",
    )
    got = data.select(expanding_predictions(1, 1, (1,))("g", "x", "y").alias("p")).first()["p"]
    assert got == pytest.approx([8.0, 10.0])


def test_sums_survive_being_sent_in_parts(spark):
    prices = spark.createDataFrame(random_prices([60, 60, 60]), SCHEMA)
    frame = models.test_frame(prices, 10)
    whole = {r["symbol"]: r for r in models.fold_history(frame, 2).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = {r["symbol"]: r for r in models.fold_history(frame, 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 3
    for k, r in whole.items():
        assert r["factor"] == pytest.approx(parts[k]["factor"], rel=1e-9, abs=1e-9) and r["rows"] == parts[k]["rows"]


def matrix_rows(spark, prices):
    rows = model_matrix(rolling_features(prices)).orderBy("symbol", "date", "event_id").collect()
    return rows


def design(x, degree):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / sd
    return np.stack([np.prod(z**np.array(p), axis=1) for p in monomials(x.shape[1], degree)], axis=1)


@pytest.mark.parametrize("degree", [1, 2, 4])
def test_walk_forward_equals_refits(spark, degree):
    # Fewer rows than terms have no single best fit.
    long = [150, 80] if degree < 3 else [420, 400]
    prices = spark.createDataFrame(random_prices([*long, 45]), SCHEMA)
    days = 10
    history = models.fold_history(models.test_frame(prices, days), degree)
    got = {r["event_id"]: r for r in models.walk_forward_polynomial(history, (degree,)).collect()}
    by_symbol = {}
    for r in matrix_rows(spark, prices):
        by_symbol.setdefault(r["symbol"], []).append(r)
    # 45 rows leave 38 complete ones, 28 for training: too few.
    assert {r["symbol"] for r in got.values()} == {"S0", "S1"}
    for symbol in ("S0", "S1"):
        rows = by_symbol[symbol]
        x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
        y = np.array([r["close"] for r in rows])
        z = design(x, degree)
        for t in range(len(rows) - days, len(rows)):
            beta = np.linalg.lstsq(z[:t], y[:t], rcond=None)[0]
            assert got[rows[t]["event_id"]]["prediction"] == pytest.approx(z[t] @ beta, rel=1e-5)


def test_training_minimum(spark):
    # 7 warm-up rows, 10 test rows, and 30 or 29 training rows.
    rows = random_prices([47, 46])
    frame = models.test_frame(spark.createDataFrame(rows, SCHEMA), 10)
    assert {r["symbol"] for r in frame.select("symbol").distinct().collect()} == {"S0"}
    skipped = models.skipped_series(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert [tuple(r) for r in skipped] == [("S1", 39)]


def test_factors_merge_grow_and_solve():
    made = np.random.default_rng(3)
    rows = made.normal(size=(60, 7)) * 10.0 ** np.arange(7)
    rows[:, 0] = 1.0
    whole = reduced(rows)
    parts = reduced(np.concatenate([reduced(rows[:3]), reduced(rows[3:40]), rows[40:]]))
    assert parts == pytest.approx(whole, rel=1e-9)
    grown = np.stack([reduced(rows[:50]), reduced(rows[:40])])
    for i in range(10):
        add_rows(grown, np.stack([rows[50 + i], rows[40 + i]]))
    assert grown[0] == pytest.approx(whole, rel=1e-8, abs=1e-8)
    beta = solve_factor(np.stack([whole, reduced(rows[:50])]), 6)
    assert beta[0] == pytest.approx(np.linalg.lstsq(rows[:, :6], rows[:, 6], rcond=None)[0], rel=1e-6)
    assert beta[1] == pytest.approx(np.linalg.lstsq(rows[:50, :6], rows[:50, 6], rcond=None)[0], rel=1e-6)


def test_exact_data_has_no_negative_errors():
    x = np.arange(40.0)[:, None]
    solver = FactorSolver(1, 3)
    factor = reduced(solver.rows(x, 3 * x[:, 0] + 1))
    for degree in (1, 2, 3):
        beta = solve_factor(factor[None], solver.used(degree))[0]
        assert 0 <= solver.error(factor, beta) < 1e-12
    assert solver.count(factor) == pytest.approx(40) and solver.spread(factor) == pytest.approx(9 * 5330)


def test_kfold_equals_refits(spark):
    prices = spark.createDataFrame(random_prices([200, 120]), SCHEMA)
    matrix = model_matrix(rolling_features(prices))
    rows = matrix.collect()
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    y = np.array([r["close"] for r in rows])
    fold = np.array([r["event_id"] % 5 for r in rows])
    got = {r["degree"]: r for r in models.kfold_polynomial(matrix, (1, 2, 3, 4), models.fold_of("event_id")).collect()}
    for degree in (1, 2, 3, 4):
        z = design(x, degree)
        errors = []
        for k in range(5):
            beta = np.linalg.lstsq(z[fold != k], y[fold != k], rcond=None)[0]
            errors.append(np.mean((y[fold == k] - z[fold == k] @ beta) ** 2))
        assert got[degree]["mse"] == pytest.approx(np.mean(errors), rel=1e-6)
    simple = models.kfold_simple(matrix, {"m": "mean_7d"}, models.fold_of("event_id")).first()
    errors = []
    for k in range(5):
        slope, intercept = np.polyfit(x[fold != k, 0], y[fold != k], 1)
        errors.append(np.mean((y[fold == k] - slope * x[fold == k, 0] - intercept) ** 2))
    assert simple["mse"] == pytest.approx(np.mean(errors)) and simple["folds"] == 5


def test_quality_and_first_best_wins(spark):
    data = [(1.0, 1.1, 1.1, 3.0), (2.0, 1.9, 1.9, 2.0), (3.0, 3.2, 3.2, 1.0)]
    wide = spark.createDataFrame(data, "close double, p_a double, p_b double, p_c double")
    got = {r["strategy"]: r for r in models.fit_quality(wide).collect()}
    assert got["a"]["best"] == "a" and got["b"]["identical_to_best"]
    assert got["b"]["rmse_vs_best"] == 0.0
    y, c = np.array([1.0, 2, 3]), np.array([3.0, 2, 1])
    assert got["c"]["rmse"] == pytest.approx(np.sqrt(np.mean((y - c) ** 2)))
    assert got["c"]["r2"] == pytest.approx(1 - 8 / 2)
    assert got["c"]["correlation"] == pytest.approx(-1.0)


def test_direction_accuracy(spark):
    rows = [(s, d, i, c, "m", p) for (s, d, i, c), p in zip(series("A", [1, 2, 1, 3]), [5.0, 6.0, 7.0, 8.0])]
    data = spark.createDataFrame(rows, SCHEMA + ", strategy string, prediction double")
    r = models.direction_accuracy(data).first()
    assert r["accuracy_pct"] == pytest.approx(200 / 3)
    assert (r["suggested_buys"], r["total_days"]) == (4, 4)
    alone = models.direction_accuracy(data.where(F.col("event_id") == 0)).first()
    assert (alone["accuracy_pct"], alone["error_pct"]) == (0.0, 100.0)


def test_compare_models(spark):
    prices = spark.createDataFrame(random_prices([120, 90]), SCHEMA)
    got = workflows.compare_models(prices, (1, 2), ("DecisionTreeRegressor",)).collect()
    assert [r["strategy"] for r in got][0] in {"LinearRegression", "PolynomialRegression_degree_2"}
    assert len(got) == 3 and all(r["folds"] == 5 for r in got)
    with pytest.raises(ValueError):
        workflows.compare_models(prices, metric="accuracy")


def test_mean_absolute_error(spark):
    prices = spark.createDataFrame(random_prices([120, 90]), SCHEMA)
    ranked = workflows.compare_models(prices, (1, 2), ("DecisionTreeRegressor",), metric="mae").collect()
    assert [r["mae"] for r in ranked] == sorted(r["mae"] for r in ranked) and len(ranked) == 3
    matrix = model_matrix(rolling_features(prices))
    rows = matrix.collect()
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    y = np.array([r["close"] for r in rows])
    fold = np.array([r["event_id"] % 5 for r in rows])
    got = {r["strategy"]: r["mae"] for r in models.kfold_absolute(matrix, (1, 2), models.fold_of("event_id")).collect()}
    for degree in (1, 2):
        z = design(x, degree)
        errors = []
        for k in range(5):
            beta = np.linalg.lstsq(z[fold != k], y[fold != k], rcond=None)[0]
            errors.append(np.mean(np.abs(y[fold == k] - z[fold == k] @ beta)))
        assert got[models.strategy_name(degree)] == pytest.approx(np.mean(errors), rel=1e-6)


def test_in_sample_linear_equals_numpy(spark):
    prices = spark.createDataFrame(random_prices([150]), SCHEMA)
    matrix = model_matrix(rolling_features(prices))
    wide = models.fit_models(matrix, models.pipelines((1,)))
    rows = wide.collect()
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    y = np.array([r["close"] for r in rows])
    z = design(x, 1)
    want = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    assert [r["p_LinearRegression"] for r in rows] == pytest.approx(want.tolist(), rel=1e-6)


def test_in_sample_degrees_equal_numpy(spark):
    prices = spark.createDataFrame(random_prices([300]), SCHEMA)
    matrix = model_matrix(rolling_features(prices))
    rows = matrix.collect()
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    y = np.array([r["close"] for r in rows])
    got = {r["strategy"]: r for r in models.in_sample_polynomial(matrix, (1, 2, 3)).collect()}
    for degree in (1, 2, 3):
        z = design(x, degree)
        p = z @ np.linalg.lstsq(z, y, rcond=None)[0]
        r = got[models.strategy_name(degree)]
        assert r["n"] == len(y) and r["mse"] == pytest.approx(np.mean((y - p) ** 2), rel=1e-6)
        assert r["correlation"] == pytest.approx(np.corrcoef(p, y)[0, 1], rel=1e-6)
        assert r["r2"] == pytest.approx(1 - np.mean((y - p) ** 2) / np.var(y), rel=1e-6)
