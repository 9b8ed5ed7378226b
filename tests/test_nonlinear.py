"""Tree walk-forward against trees grown by plain loops over raw rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.functions.trees import BINS, REACH, STEPWISE_TREES, TreeSpec, grow
from candlewick.operators import models
from candlewick.operators.features import model_matrix, rolling_features
from candlewick.operators.nonlinear import binned_history, walk_forward_trees
from candlewick.plans import workflows
from helpers import SCHEMA, random_prices


def plain_tree(bins, y, depth, least=1):
    """Nested (feature, cut, left, right) or a mean, by trying every split."""
    mean = y.mean()
    best = None
    if depth:
        for f in range(bins.shape[1]):
            for cut in range(BINS - 1):
                left = bins[:, f] <= cut
                if left.sum() < least or (~left).sum() < least:
                    continue
                gain = left.sum() * y[left].mean() ** 2 + (~left).sum() * y[~left].mean() ** 2 - len(y) * mean**2
                if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                    best = (gain, f, cut, left)
    if best is None or best[0] <= 1e-12 * max(y.sum() ** 2, 1e-300):
        return mean
    _, f, cut, left = best
    return f, cut, plain_tree(bins[left], y[left], depth - 1, least), plain_tree(bins[~left], y[~left], depth - 1, least)


def ask(tree, row):
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


@pytest.mark.parametrize("spec", [TreeSpec(), TreeSpec(depth=2, rows=4), TreeSpec(depth=1)])
def test_tree_equals_plain_search(spec):
    made = np.random.default_rng(3)
    bins = made.integers(0, BINS, (300, 5))
    y = np.sin(bins[:, 0]) + (bins[:, 3] > 7) * 2 + made.normal(0, 0.1, 300)
    cells, inverse = np.unique(bins, axis=0, return_inverse=True)
    tree = grow(cells, np.bincount(inverse).astype(float), np.bincount(inverse, y), spec)
    plain = plain_tree(bins, y, spec.depth, spec.rows)
    asked = made.integers(0, BINS, (200, 5))
    assert tree.predict(asked) == pytest.approx([ask(plain, r) for r in asked])
    flat = grow(cells, np.bincount(inverse).astype(float), np.zeros(len(cells)), spec)
    assert (flat.predict(asked) == 0).all()


def refits(rows, days, name):
    """The reference loop: before each test row a new fit on all rows before it."""
    spec = STEPWISE_TREES[name]
    x = np.array([[r[f] for f in MODEL_FEATURES] for r in rows])
    y = np.array([r["close"] for r in rows])
    train = slice(0, len(rows) - days)
    mean, spread = x[train].mean(axis=0), x[train].std(axis=0, ddof=1)
    bins = np.clip(np.floor(((x - mean) / spread + REACH) * (BINS / (2 * REACH))), 0, BINS - 1).astype(int)
    out = []
    for t in range(len(rows) - days, len(rows)):
        if spec.trees == 1:
            out.append(ask(plain_tree(bins[:t], y[:t] - y[train].mean(), spec.depth), bins[t]) + y[train].mean())
            continue
        fit, guess = np.full(t, y[:t].mean()), y[:t].mean()
        for _ in range(spec.trees):
            tree = plain_tree(bins[:t], y[:t] - fit, spec.depth)
            fit = fit + spec.rate * np.array([ask(tree, b) for b in bins[:t]])
            guess += spec.rate * ask(tree, bins[t])
        out.append(guess)
    return out


@pytest.mark.parametrize("name", list(STEPWISE_TREES))
def test_walk_forward_equals_refits(spark, name):
    prices = spark.createDataFrame(random_prices([90, 60, 20]), SCHEMA)
    days = 6
    history = binned_history(models.test_frame(prices, days))
    got = {}
    for r in walk_forward_trees(history, (name,)).collect():
        assert r["strategy"] == name
        got.setdefault(r["symbol"], []).append((r["date"], r["event_id"], r["prediction"]))
    rows = {}
    for r in model_matrix(rolling_features(prices)).orderBy("symbol", "date", "event_id").collect():
        rows.setdefault(r["symbol"], []).append(r)
    assert set(got) == {"S0", "S1"}  # S2 is too short
    for symbol, found in got.items():
        want = refits(rows[symbol], days, name)
        assert [p for *_, p in sorted(found)] == pytest.approx(want, rel=1e-6)


def test_constant_series_and_many_steps(spark):
    prices = spark.createDataFrame(random_prices([80]), SCHEMA).withColumn("close", F.lit(5.0))
    got = walk_forward_trees(binned_history(models.test_frame(prices, 9))).collect()
    assert len(got) == 9 * len(STEPWISE_TREES) and all(r["prediction"] == pytest.approx(5.0) for r in got)
    with pytest.raises(ValueError):
        walk_forward_trees(binned_history(models.test_frame(prices, 9)), ("no such tree",))


def test_backtest_has_trees(spark):
    prices = spark.createDataFrame(random_prices([90, 80]), SCHEMA)
    run = workflows.backtest(prices, degrees=(1,), trees=("DecisionTreeRegressor",), test_days=5)
    names = {r["strategy"] for r in run["predictions"].collect()}
    assert names == {"LinearRegression", "DecisionTreeRegressor"}
    counted = run["days"].groupBy("strategy").count().collect()
    assert {r["strategy"] for r in counted} >= names


def test_tasks_get_arrays_of_numbers(spark, capsys):
    # One Python object per cell of a batch was gigabytes where series are many.
    prices = spark.createDataFrame(random_prices([90, 80]), SCHEMA)
    walk_forward_trees(binned_history(models.test_frame(prices, 5)), ("DecisionStump",)).explain()
    called = [line for line in capsys.readouterr().out.splitlines() if "ArrowEvalPython" in line]
    assert called and all(re.search(r"fitted\(cells#\d+\.cell", line) for line in called)
