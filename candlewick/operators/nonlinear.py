"""Walk-forward forecasts of tree regressors, refitted before every test row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES, SeriesSpec
from candlewick.functions.trees import BINS, REACH, STEPWISE_TREES, TreeSpec, fit_predict
from candlewick.operators import models

#: Test rows of a series that one task fits in turn.
STEPS = 4


def _bin(value: Column, mean: Column, spread: Column) -> Column:
    """Bins of equal width within REACH standard deviations, open ones outside."""
    z = F.when(spread > 0, (value - mean) / spread).otherwise(F.lit(0.0))
    at = F.floor((z + REACH) * (BINS / (2 * REACH)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("long")


def binned_history(frame: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """One row per series: its training rows as weighted cells and its test rows,
    both with their bins.

    ``frame`` is that of ``models.test_frame``.  Features are binned by the mean and
    standard deviation of the training rows.  Rows of equal bins are added up before
    they are shuffled, so however long a history is, and however many rows one series
    has of all, a series has at most BINS ** 5 cells and ``test_days`` test rows.
    """
    keys = list(spec.keys)
    shifted = [models._scaled(F.col(f), f).alias(f"__x{i}") for i, f in enumerate(MODEL_FEATURES)]
    passed = [*spec.order, spec.value, "y"]
    rows = frame.select(*keys, *passed, "is_test", "__mean", "__spread", *shifted)
    train = F.when(~F.col("is_test"), F.lit(True))
    names = [f"__x{i}" for i in range(len(MODEL_FEATURES))]
    level = rows.groupBy(*keys).agg(
        *[F.avg(F.when(train, F.col(x))).alias(f"__m{x}") for x in names],
        *[F.stddev_samp(F.when(train, F.col(x))).alias(f"__s{x}") for x in names],
    )
    cell = sum(
        (_bin(F.col(x), F.col(f"__m{x}"), F.col(f"__s{x}")) * F.lit(BINS**i) for i, x in enumerate(names)),
        F.lit(0).cast("long"),
    )
    target = (F.col("y") - F.col("__mean")) / F.col("__spread")
    binned = rows.join(level, keys).select(
        *keys, *passed, "is_test", "__mean", "__spread", cell.alias("cell"), target.alias("t")
    )
    # Test rows keep their own group each: their order columns tell them apart.
    own = [F.when(F.col("is_test"), F.col(c)).alias(c) for c in passed]
    added = binned.groupBy(*keys, "is_test", "cell", *own).agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.max("__mean").alias("__mean"), F.max("__spread").alias("__spread")
    )
    cells = F.when(~F.col("is_test"), F.struct("cell", "n", "total"))
    tests = F.when(F.col("is_test"), F.struct(*passed, "cell", F.col("total").alias("t")))
    return added.groupBy(*keys).agg(
        F.array_sort(F.collect_list(cells)).alias("cells"),
        F.array_sort(F.collect_list(tests)).alias("rows"),
        F.max("__mean").alias("__mean"),
        F.max("__spread").alias("__spread"),
    )


def _bins(cells: np.ndarray) -> np.ndarray:
    return (cells[:, None] >> (4 * np.arange(len(MODEL_FEATURES)))) & (BINS - 1)


def step_predictions(
    cells: tuple[np.ndarray, np.ndarray, np.ndarray], tests: tuple[np.ndarray, np.ndarray],
    steps: Sequence[int], spec: TreeSpec,
) -> list[float]:
    """For each step the prediction of that test row from all rows before it."""
    cell, n, total = cells
    at, target = tests
    out = []
    for k in steps:
        bins = _bins(np.concatenate([cell, at[:k]]))
        counts = np.concatenate([n, np.ones(k)])
        sums = np.concatenate([total, target[:k]])
        out.append(float(fit_predict(bins, counts, sums, _bins(at[k : k + 1]), spec)[0]))
    return out


def walk_forward_trees(
    history: DataFrame, trees: Sequence[str] = tuple(STEPWISE_TREES), spec: SeriesSpec = SeriesSpec()
) -> DataFrame:
    """Predictions of tree regressors, each refitted on all rows before a test row.

    ``history`` is that of ``binned_history``; the steps of a series are dealt out in
    blocks, so that a task fits a few steps of one series and a series with many
    cells occupies several tasks.
    """
    unknown = set(trees) - set(STEPWISE_TREES)
    if unknown:
        raise ValueError(f"no stepwise tree regressor: {sorted(unknown)}")

    @F.pandas_udf("array<array<double>>")
    def fitted(
        cell: pd.Series, n: pd.Series, total: pd.Series, at: pd.Series, t: pd.Series, start: pd.Series
    ) -> pd.Series:
        out = []
        for c, m, s, r, y, a in zip(cell, n, total, at, t, start, strict=True):
            steps = range(int(a), min(int(a) + STEPS, len(r)))
            known, tests = (c, m.astype(float), s), (r, y)
            out.append([step_predictions(known, tests, steps, STEPWISE_TREES[name]) for name in trees])
        return pd.Series(out)

    keys = list(spec.keys)
    begin = F.explode(F.sequence(F.lit(0), F.size("rows") - 1, F.lit(STEPS)))
    blocks = history.where(F.size("rows") > 0).withColumn("start", begin).repartition(*keys, "start")
    # Arrays of numbers arrive as views of the batch; structs would be one object a cell.
    numbers = ("cells.cell", "cells.n", "cells.total", "rows.cell", "rows.t")
    predicted = blocks.withColumn("p", fitted(*map(F.col, numbers), "start"))
    picked = F.arrays_zip(F.slice("rows", F.col("start") + 1, F.lit(STEPS)).alias("row"), F.col("of_tree.p").alias("p"))
    named = F.transform(
        "p", lambda p, i: F.struct(F.element_at(F.array(*map(F.lit, trees)), i.cast("int") + 1).alias("strategy"), p.alias("p"))
    )
    rows = (
        predicted.select(*keys, "__mean", "__spread", "rows", "start", F.explode(named).alias("of_tree"))
        .withColumn("picked", F.explode(picked))
    )
    kept = [F.col(f"picked.row.{c}").alias(c) for c in (*spec.order, spec.value, "y")]
    return rows.select(
        *keys, *kept, F.col("of_tree.strategy").alias("strategy"),
        (F.col("__mean") + F.col("__spread") * F.col("picked.p")).alias("prediction"),
    )
