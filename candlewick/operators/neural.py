"""A neural regressor with one hidden layer, trained over the whole table.

Every round is one Spark job: tasks sum the slopes of the squared error over their
rows, Spark adds the sums up, and the driver moves a few hundred weights.  The rows
of all folds are read once per round, whatever the number of models; they are stored
in blocks of one fold, dealt evenly over the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.storage import settle

STRATEGY = "NeuralRegressor"

#: Rows of a block.  The units' outputs over a block fit a core's cache.
BLOCK = 1024


@dataclass(frozen=True)
class NeuralSpec:
    """hidden: units of the layer; rounds: passes over the rows; rate: first step
    length, which falls to nothing as a cosine; penalty: on squared weights."""

    hidden: int = 50
    rounds: int = 120
    rate: float = 0.03
    penalty: float = 1e-4
    seed: int = 42


def start_weights(inputs: int, spec: NeuralSpec) -> np.ndarray:
    """Hidden weights and offsets, then output weights and offset, in one row."""
    made = np.random.default_rng(spec.seed)
    near = np.sqrt(6 / (inputs + spec.hidden))
    far = np.sqrt(6 / (spec.hidden + 1))
    parts = (
        made.uniform(-near, near, inputs * spec.hidden),
        made.uniform(-near, near, spec.hidden),
        made.uniform(-far, far, spec.hidden),
        np.zeros(1),
    )
    return np.concatenate(parts)


def _layers(weights: np.ndarray, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    hidden = (len(weights) - 1) // (inputs + 2)
    a, b = inputs * hidden, (inputs + 1) * hidden
    return weights[:a].reshape(inputs, hidden), weights[a:b], weights[b:-1], float(weights[-1])


def outputs(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    first, offset, last, constant = _layers(weights, x.shape[1])
    return np.maximum(x @ first + offset, 0.0) @ last + constant


def slopes(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the rows: the slopes of half the squared error, the squared error, the rows."""
    _, offset, last, constant = _layers(weights, x.shape[1])
    hidden, x = len(offset), np.column_stack([x, np.ones(len(y))])
    # The offsets follow the hidden weights: those of an input that is always 1.
    on = x @ weights[: x.shape[1] * hidden].reshape(-1, hidden)
    active = (on > 0).astype(float)
    on *= active
    gap = on @ last + constant - y
    # Output weights and gaps are factors of whole columns and rows of the units' slopes.
    back = (x * gap[:, None]).T @ active * last
    parts = back.ravel(), gap @ on, [gap.sum(), gap @ gap, float(len(y))]
    return np.concatenate(parts)


def trained(sums_of: Callable[[np.ndarray], np.ndarray], models: int, inputs: int, spec: NeuralSpec) -> np.ndarray:
    """Weights of each model after all rounds of Adam, one row each.

    ``sums_of`` gives the rows of ``slopes`` for the present weights of all models."""
    weights = np.tile(start_weights(inputs, spec), (models, 1))
    drift, size = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, spec.rounds + 1):
        sums = sums_of(weights)
        slope = sums[:, :-2] / np.maximum(sums[:, -1:], 1) + spec.penalty * weights
        drift = 0.9 * drift + 0.1 * slope
        size = 0.999 * size + 0.001 * slope**2
        step = spec.rate * (1 + np.cos(np.pi * (k - 1) / spec.rounds)) / 2
        weights = weights - step * (drift / (1 - 0.9**k)) / (np.sqrt(size / (1 - 0.999**k)) + 1e-8)
    return weights


def _packed(inputs: int):
    """Rows (fold, x0, ..., the target last) as blocks of one fold, row after row."""

    def blocks(fold: int, rows: np.ndarray) -> pa.RecordBatch:
        parts = [rows[i : i + BLOCK].tobytes() for i in range(0, len(rows), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array([fold] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["fold", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            rows = np.column_stack([batch.column(f"x{i}").to_numpy() for i in range(inputs + 1)])
            for k in np.unique(fold).tolist():
                part = rows[fold == k]
                if k in waiting:
                    part = np.concatenate([waiting[k], part])
                full = len(part) - len(part) % BLOCK
                waiting[k] = part[full:]
                if full:
                    yield blocks(k, part[:full])
        for k, part in waiting.items():
            if len(part):
                yield blocks(k, part)

    return run


def _unpacked(batch: pa.RecordBatch, inputs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Fold, features and targets of each block."""
    for fold, numbers in zip(batch.column("fold").to_pylist(), batch.column("numbers"), strict=True):
        rows = np.frombuffer(numbers.as_buffer()).reshape(-1, inputs + 1)
        yield fold, np.ascontiguousarray(rows[:, :-1]), rows[:, -1].copy()


def _task_sums(weights: np.ndarray, left_out: Sequence[int], inputs: int):
    """Each task's sums for every model over the blocks outside its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), weights.shape[1] + 2))
        for batch in batches:
            for fold, x, y in _unpacked(batch, inputs):
                for m, k in enumerate(left_out):
                    if fold != k:
                        total[m] += slopes(weights[m], x, y)
        model, place = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(model.ravel()), pa.array(place.ravel()), pa.array(total.ravel())], names=["model", "place", "value"]
        )

    return run


def fit_neural(rows: DataFrame, left_out: Sequence[int], inputs: int, spec: NeuralSpec) -> np.ndarray:
    """Weights of one model per entry of ``left_out``: the fold it does not see.

    ``rows`` are the blocks of ``_standard_rows``, read once per round.  What comes to
    the driver in a round is one number per weight and model.
    """

    def sums_of(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(left_out), weights.shape[1] + 2))
        parts = kept.mapInArrow(_task_sums(weights, left_out, inputs), "model long, place long, value double")
        for r in parts.groupBy("model", "place").agg(F.sum("value").alias("value")).collect():
            out[r["model"], r["place"]] = r["value"]
        return out

    kept = rows.persist()
    try:
        return trained(sums_of, len(left_out), inputs, spec)
    finally:
        kept.unpersist()


def _standard_rows(matrix: DataFrame, features: Sequence[str], y: str, fold: Column) -> tuple[DataFrame, DataFrame]:
    """Stored blocks (fold, numbers) of rows x0, ..., the target last, standardised over
    all of them, and the target's unit as one row.

    A series may be one task's; the blocks are dealt out anew, so that every round
    occupies all cores.
    """
    names = [*features, y]
    stored = settle(matrix.select(fold.alias("fold"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]))
    columns = [f"c{i}" for i in range(len(names))]
    aggregates = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    level = stored.agg(F.struct(*aggregates)).scalar()

    def standard(c: str) -> Column:
        spread = F.col(f"__l.s_{c}")
        return (F.col(c) - F.col(f"__l.m_{c}")) / F.when(spread > 0, spread).otherwise(1.0)

    inputs = [standard(c).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = stored.withColumn("__l", level).select("fold", *inputs)
    tasks = matrix.sparkSession.sparkContext.defaultParallelism
    blocks = rows.mapInArrow(_packed(len(features)), "fold int, numbers binary").repartition(tasks)
    return settle(blocks), stored.agg(F.stddev_samp(columns[-1]).alias("unit"))


_ERRORS = "fold int, n long, sse double, sae double, sy double, syy double, sp double, spp double, syp double"


def _task_errors(weights: np.ndarray, held_out: Sequence[int] | None, inputs: int):
    """Each task's sums of errors, targets and predictions per fold: of the model that
    left the fold out, or (None) of the only model."""
    keys = [0] if held_out is None else list(held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(keys), 8))
        for batch in batches:
            for fold, x, y in _unpacked(batch, inputs):
                for m, k in enumerate(keys):
                    if held_out is None or fold == k:
                        p = outputs(weights[m], x)
                        gap = y - p
                        total[m] += (len(y), gap @ gap, np.abs(gap).sum(), y.sum(), y @ y, p.sum(), p @ p, y @ p)
        names = [part.split()[0] for part in _ERRORS.split(", ")]
        columns = [pa.array(keys, pa.int32()), pa.array(total[:, 0].astype(np.int64)), *map(pa.array, total[:, 1:].T)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _per_fold(rows: DataFrame, weights: np.ndarray, held_out: Sequence[int] | None, inputs: int) -> DataFrame:
    sums = rows.mapInArrow(_task_errors(weights, held_out, inputs), _ERRORS)
    names = [part.split()[0] for part in _ERRORS.split(", ")][1:]
    spread = F.col("syy") / F.col("n") - (F.col("sy") / F.col("n")) ** 2
    return (
        sums.groupBy("fold").agg(*[F.sum(c).alias(c) for c in names]).where("n > 0")
        .withColumns({"mse": F.col("sse") / F.col("n"), "mae": F.col("sae") / F.col("n"), "spread": spread})
        .withColumn("r2", 1 - F.try_divide("mse", "spread"))
    )


def kfold_neural(
    matrix: DataFrame, fold: Column, folds: int, features: Sequence[str] = MODEL_FEATURES, y: str = "close",
    spec: NeuralSpec = NeuralSpec(),
) -> DataFrame:
    """Cross-validated errors: strategy, folds, mse, rmse, r2, mae.  The models of all
    folds are trained in the same passes; training runs while the result is built.
    No rows: no row."""
    rows, unit = _standard_rows(matrix, features, y, fold)
    left_out = list(range(folds))
    weights = fit_neural(rows, left_out, len(features), spec)
    scored = _per_fold(rows, weights, left_out, len(features))
    out = scored.agg(
        F.count(F.lit(1)).cast("int").alias("folds"), F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2")
    )
    # Both sides are single rows.
    return out.where("folds > 0").crossJoin(unit).select(
        F.lit(STRATEGY).alias("strategy"), "folds", (F.col("mse") * F.col("unit") ** 2).alias("mse"),
        (F.sqrt("mse") * F.col("unit")).alias("rmse"), "r2", (F.col("mae") * F.col("unit")).alias("mae"),
    )


def in_sample_neural(
    matrix: DataFrame, features: Sequence[str] = MODEL_FEATURES, y: str = "close", spec: NeuralSpec = NeuralSpec()
) -> DataFrame:
    """In-sample quality: strategy, n, mse, rmse, r2, correlation.  No rows: no row."""
    rows, unit = _standard_rows(matrix, features, y, F.lit(0))
    weights = fit_neural(rows, [-1], len(features), spec)
    scored = _per_fold(rows, weights, None, len(features))
    n = F.col("n")
    both = n * F.col("syp") - F.col("sy") * F.col("sp")
    alone = F.sqrt(n * F.col("syy") - F.col("sy") ** 2) * F.sqrt(n * F.col("spp") - F.col("sp") ** 2)
    return scored.crossJoin(unit).select(
        F.lit(STRATEGY).alias("strategy"), "n", (F.col("mse") * F.col("unit") ** 2).alias("mse"),
        (F.sqrt("mse") * F.col("unit")).alias("rmse"), "r2", F.try_divide(both, alone).alias("correlation"),
    )
