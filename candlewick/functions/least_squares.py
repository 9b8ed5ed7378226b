"""Least squares from triangular factors.

The rows [terms | target] of a group reduce to one small triangular matrix R with
the same products (R'R), found by orthogonal steps only, so no digits are lost by
squaring.  Factors of parts merge by stacking and reducing again: across tasks,
across folds and over time.  One pass that reduces the rows replaces any number
of refits: a factor gives the fit of every polynomial up to its degree, and the
error of any other fit on its group as the length of a vector.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Ship these functions inside the plan, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Powers = tuple[int, ...]


def monomials(variables: int, degree: int) -> list[Powers]:
    """Exponents of every product of at most ``degree`` variables, constant first."""
    out = []
    for d in range(degree + 1):
        for picks in combinations_with_replacement(range(variables), d):
            out.append(tuple(picks.count(i) for i in range(variables)))
    return out


def expand(x: np.ndarray, terms: list[Powers]) -> np.ndarray:
    """Terms of many rows, each from a shorter term times one variable."""
    index = {t: i for i, t in enumerate(terms)}
    out = np.ones((len(x), len(terms)))
    for i, t in enumerate(terms[1:], start=1):
        last = max(j for j, p in enumerate(t) if p)
        shorter = tuple(p - (j == last) for j, p in enumerate(t))
        out[:, i] = out[:, index[shorter]] * x[:, last]
    return out


def reduced(rows: np.ndarray) -> np.ndarray:
    """Square triangular factor of ``rows``; diagonal entries are not negative."""
    width = rows.shape[-1]
    factor = np.linalg.qr(rows, mode="r")
    sign = np.where(np.diag(factor) < 0, -1.0, 1.0)
    out = np.zeros((width, width))
    out[: len(factor)] = factor * sign[:, None]
    return out


def merged(column) -> Column:
    """One factor from an array of factors; null if there is none."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def merge(lists: pd.Series) -> pd.Series:
        out = []
        for factors in lists:
            if factors is None or not len(factors):
                out.append(None)
                continue
            stack = np.stack([np.asarray(f, dtype=float) for f in factors])
            width = int(round(stack.shape[1] ** 0.5))
            out.append(reduced(stack.reshape(-1, width)).ravel())
        return pd.Series(out)

    return merge(column)


#: A diagonal entry below this share of its column's length marks a term that the
#: others determine; such fits take the solution of least length.
_DEPENDENT = 1e-11


def solve_factor(factors: np.ndarray, terms: int) -> np.ndarray:
    """Coefficients of the first ``terms`` columns for the last one, for each of
    many factors; columns are scaled to unit length before the solve."""
    r, target = factors[:, :terms, :terms], factors[:, :terms, -1]
    size = np.sqrt((r * r).sum(axis=1))
    size = np.where(size > 0, size, 1.0)
    scaled = r / size[:, None, :]
    pivot = np.diagonal(scaled, axis1=1, axis2=2)
    clear = (np.abs(pivot) > _DEPENDENT).all(axis=1)
    beta = np.zeros(target.shape)
    some, rest = scaled[clear], target[clear].copy()
    out = np.zeros(rest.shape)
    for k in range(terms - 1, -1, -1):
        out[:, k] = rest[:, k] / some[:, k, k]
        rest[:, :k] -= some[:, :k, k] * out[:, k, None]
    beta[clear] = out
    for i in np.flatnonzero(~clear):
        beta[i] = np.linalg.lstsq(scaled[i], target[i], rcond=_DEPENDENT)[0]
    return beta / size


def add_rows(factors: np.ndarray, rows: np.ndarray) -> None:
    """Add one row to each of many factors in place, by plane rotations."""
    rows = rows.copy()
    for k in range(rows.shape[1]):
        a, b = factors[:, k, k], rows[:, k]
        length = np.hypot(a, b)
        turn = length > 0
        c = np.where(turn, a / np.where(turn, length, 1.0), 1.0)[:, None]
        s = np.where(turn, b / np.where(turn, length, 1.0), 0.0)[:, None]
        above = factors[:, k, k:].copy()
        factors[:, k, k:] = c * above + s * rows[:, k:]
        rows[:, k:] = c * rows[:, k:] - s * above


def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, row numbers) of each key in a batch."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        encoded = batch.column(k).dictionary_encode()
        codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
    rows = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[rows])) + 1
    for part in np.split(rows, cuts):
        first = int(part[0])
        yield tuple(batch.column(k)[first].as_py() for k in keys), part


# A task sends on its factors once they fill this many bytes.
_MATRIX_BYTES = 64 << 20


def reduce_rows(
    keys: Sequence[str], inputs: Sequence[str], degree: int, passed: Sequence[str] = ()
) -> Callable:
    """Task function for ``mapInArrow``.

    Reduces, per key, the rows of all terms of ``inputs`` (features, then the
    target).  Output rows are (keys, passed, factor): one row per key reduced, and,
    if ``passed`` is given, the rows flagged ``is_test`` as they are with a null
    factor.  A key may come out several times; the caller merges.
    """
    terms = monomials(len(inputs) - 1, degree)
    width = len(terms) + 1
    most = max(16, _MATRIX_BYTES // (8 * width * width))

    def sent(held: dict[tuple, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        n = len(held)
        arrays = [
            pa.array([label[i] for label in held], schema.field(k).type) for i, k in enumerate(keys)
        ]
        arrays += [pa.nulls(n, schema.field(c).type) for c in passed]
        flat = np.concatenate([g.ravel() for g in held.values()])
        offsets = pa.array(np.arange(n + 1) * width * width, pa.int32())
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *passed, "factor"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            if passed:
                flag = batch.column("is_test")
                tests = batch.filter(flag)
                if tests.num_rows:
                    arrays = [tests.column(c) for c in (*keys, *passed)]
                    arrays.append(pa.nulls(tests.num_rows, pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *passed, "factor"])
                batch = batch.filter(pc.invert(flag))
            if not batch.num_rows:
                continue
            x = np.column_stack(
                [batch.column(c).to_numpy(zero_copy_only=False) for c in inputs[:-1]]
            )
            y = batch.column(inputs[-1]).to_numpy(zero_copy_only=False)
            z = np.column_stack([expand(x, terms), y])
            for label, rows in _groups(batch, keys):
                part = z[rows]
                if label in held:
                    part = np.concatenate([held[label], part])
                held[label] = reduced(part)
            if len(held) >= most:
                yield sent(held, schema)
                held = {}
        if held:
            yield sent(held, schema)

    return run


class FactorSolver:
    """Fits of any degree up to ``degree`` from a factor."""

    def __init__(self, variables: int, degree: int) -> None:
        self.terms = monomials(variables, degree)
        self.width = len(self.terms) + 1

    def used(self, degree: int) -> int:
        """Terms of at most this degree; they come first."""
        return sum(sum(t) <= degree for t in self.terms)

    def rows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.column_stack([expand(x, self.terms), y])

    def error(self, factor: np.ndarray, beta: np.ndarray) -> float:
        """Sum of squared errors of ``beta`` on the rows reduced to ``factor``."""
        weights = np.zeros(self.width)
        weights[: len(beta)] = beta
        weights[-1] = -1.0
        gap = factor @ weights
        return float(gap @ gap)

    @staticmethod
    def count(factor: np.ndarray) -> float:
        """Rows of a factor; its first column is constant."""
        return float(factor[0, 0] ** 2)

    @staticmethod
    def spread(factor: np.ndarray) -> float:
        """Squared distances of the target from its mean."""
        rest = factor[1:, -1]
        return float(rest @ rest)


# Series whose factors are moved on together.
_TOGETHER_BYTES = 32 << 20


def expanding_predictions(variables: int, max_degree: int, degrees: Sequence[int]):
    """UDF: (factor of the training rows, features and targets of the test rows in
    order) -> one prediction per degree and test row, degree by degree.  Before
    each further test row, the row just passed is added.

    Many series take each step together: a step is one rotation per column and
    one triangular solve per degree.
    """
    degrees = tuple(degrees)

    @F.pandas_udf(ArrayType(DoubleType()))
    def predict(factors: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        solver = FactorSolver(variables, max_degree)
        used = [solver.used(d) for d in degrees]
        together = max(1, _TOGETHER_BYTES // (8 * solver.width**2))
        results: list[np.ndarray] = []
        for at in range(0, len(factors), together):
            rows = [
                solver.rows(np.stack([np.asarray(r, dtype=float) for r in x]), np.asarray(y, dtype=float))
                for x, y in zip(xs[at : at + together], ys[at : at + together])
            ]
            sizes = np.array([len(z) for z in rows])
            state = np.stack([np.asarray(f, dtype=float) for f in factors[at : at + together]])
            state = state.reshape(-1, solver.width, solver.width)
            out = [np.empty((len(degrees), n)) for n in sizes]
            for step in range(sizes.max(initial=0)):
                going = np.flatnonzero(sizes > step)
                z = np.stack([rows[i][step] for i in going])
                now = state[going]
                for k, m in enumerate(used):
                    values = (z[:, :m] * solve_factor(now, m)).sum(axis=1)
                    for i, v in zip(going, values):
                        out[i][k, step] = v
                add_rows(now, z)
                state[going] = now
            results += [o.ravel() for o in out]
        return pd.Series(results)

    return predict


def _held_out_fits(solver: FactorSolver, factors: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients for each fold, from the merge of the other folds' factors."""
    empty = np.zeros((1, solver.width))
    folds = range(len(factors))
    others = [
        reduced(np.concatenate([empty, *(factors[j] for j in folds if j != k)])) for k in folds
    ]
    return solve_factor(np.stack(others), solver.used(degree))


def _factors_by_fold(part: pd.DataFrame, solver: FactorSolver) -> tuple[list, np.ndarray]:
    part = part.sort_values("fold")
    stack = np.stack(part["factor"].to_list())
    return part["fold"].to_list(), stack.reshape(-1, solver.width, solver.width)


def fold_errors(variables: int, degree: int, degrees: Sequence[int]) -> Callable:
    """Group function over all folds: mean held-out MSE and R2 per degree."""
    degrees = tuple(degrees)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        solver = FactorSolver(variables, degree)
        _, factors = _factors_by_fold(part, solver)
        unit = float(part["unit"].iloc[0])
        rows = []
        for d in degrees:
            errors, scores = [], []
            for held, beta in zip(factors, _held_out_fits(solver, factors, d)):
                sse, spread = solver.error(held, beta), solver.spread(held)
                errors.append(sse / solver.count(held))
                scores.append(1.0 - sse / spread if spread > 0 else np.nan)
            rows.append((d, len(factors), float(np.mean(errors)) * unit * unit, float(np.mean(scores))))
        return pd.DataFrame(rows, columns=["degree", "folds", "mse", "r2"])

    return run


def fold_coefficients(variables: int, degree: int, degrees: Sequence[int]) -> Callable:
    """Group function over all folds: the held-out fits themselves."""
    degrees = tuple(degrees)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        solver = FactorSolver(variables, degree)
        names, factors = _factors_by_fold(part, solver)
        rows = [
            (fold, d, beta.tolist())
            for d in degrees
            for fold, beta in zip(names, _held_out_fits(solver, factors, d))
        ]
        return pd.DataFrame(rows, columns=["fold", "degree", "beta"])

    return run


def absolute_errors(
    inputs: Sequence[str], degree: int, fits: dict[tuple[int, int], list[float]]
) -> Callable:
    """Task function for ``mapInArrow``: sums of absolute held-out errors per
    (fold, degree) and batch."""
    terms = monomials(len(inputs) - 1, degree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs[:-1]])
            y = batch.column(inputs[-1]).to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            z = expand(x, terms)
            out = []
            for (k, d), beta in fits.items():
                mine = fold == k
                gap = np.abs(y[mine] - z[mine][:, : len(beta)] @ np.asarray(beta))
                out.append((k, d, int(mine.sum()), float(gap.sum())))
            columns = zip(*out)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["fold", "degree", "n", "total"])

    return run


def pooled_errors(variables: int, degree: int, degrees: Sequence[int]) -> Callable:
    """Group function over one factor: n, MSE and spread of the in-sample fits."""
    degrees = tuple(degrees)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        solver = FactorSolver(variables, degree)
        factor = np.asarray(part["factor"].iloc[0], dtype=float).reshape(solver.width, solver.width)
        unit, n = float(part["unit"].iloc[0]), solver.count(factor)
        rows = []
        for d in degrees:
            beta = solve_factor(factor[None], solver.used(d))[0]
            sse = solver.error(factor, beta)
            rows.append((d, round(n), sse / n * unit * unit, solver.spread(factor) / n * unit * unit))
        return pd.DataFrame(rows, columns=["degree", "n", "mse", "variance"])

    return run
