"""Regression trees over binned rows.

A row is known by the bins of its features, so rows in the same bins add up to one
weighted cell (count, sum of the target) and a fit reads cells instead of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins per feature.  Five features give at most BINS ** 5 cells, whatever the rows.
BINS = 16
#: Distance from the mean, in standard deviations, from which on bins are open.
REACH = 2.5


@dataclass(frozen=True)
class TreeSpec:
    """depth: of a tree; rows: least number in a leaf; trees: boosted one after the
    other (1: a single tree); rate: share of each one's step that is taken."""

    depth: int = 5
    rows: int = 1
    trees: int = 1
    rate: float = 1.0


#: The tree regressors that a walk-forward run can refit at each step.
STEPWISE_TREES = {
    "DecisionStump": TreeSpec(depth=1),
    "DecisionTreeRegressor": TreeSpec(),
    "GradientBoostingRegressor": TreeSpec(depth=3, trees=20, rate=0.1),
}


@dataclass
class Tree:
    """Nodes level by level; feature -1: a leaf.  Children of node i are 2 i + 1
    (bins up to ``cut``) and 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        while True:
            on = np.flatnonzero(self.feature[node] >= 0)
            if not len(on):
                return self.value[node]
            at = node[on]
            right = bins[on, self.feature[at]] > self.cut[at]
            node[on] = 2 * at + 1 + right


def grow(bins: np.ndarray, n: np.ndarray, total: np.ndarray, spec: TreeSpec) -> Tree:
    """The tree of greatest gain at each node: cells with their counts and target sums.

    A split needs a gain and ``rows`` rows on both sides; of equal gains the first
    feature's lowest cut is taken.
    """
    size = (1 << (spec.depth + 1)) - 1
    features = bins.shape[1]
    feature, cut = np.full(size, -1), np.zeros(size, np.int64)
    count, sums = np.zeros(size), np.zeros(size)
    node = np.zeros(len(bins), np.int64)
    count[0], sums[0] = n.sum(), total.sum()
    columns = bins.astype(np.int64) + BINS * np.arange(features)
    width = features * BINS
    for level in range(spec.depth):
        first, wide = (1 << level) - 1, 1 << level
        on = np.flatnonzero(node >= first)
        if not len(on):
            break
        place = ((node[on] - first)[:, None] * width + columns[on]).ravel()

        def table(weights: np.ndarray) -> np.ndarray:
            flat = np.bincount(place, np.repeat(weights[on], features), wide * width)
            return np.cumsum(flat.reshape(wide, features, BINS), axis=2)[:, :, :-1]

        left_n, left_sum = table(n), table(total)
        here = slice(first, first + wide)
        right_n = count[here, None, None] - left_n
        right_sum = sums[here, None, None] - left_sum
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_sum**2 / left_n + right_sum**2 / right_n
            gain -= (sums[here] ** 2 / count[here])[:, None, None]
        gain = np.where((left_n >= spec.rows) & (right_n >= spec.rows), gain, -np.inf).reshape(wide, -1)
        # Gains that differ in the last digits only count as equal.
        top = gain.max(axis=1)
        best = (gain >= (top - 1e-9 * np.abs(top))[:, None]).argmax(axis=1)
        split = np.flatnonzero(top > 1e-12 * np.maximum(sums[here] ** 2, 1e-300))
        rows = np.arange(wide)
        at = first + split
        feature[at], cut[at] = best[split] // (BINS - 1), best[split] % (BINS - 1)
        for side, (m, s) in enumerate(((left_n, left_sum), (right_n, right_sum))):
            child = 2 * at + 1 + side
            count[child] = m.reshape(wide, -1)[rows[split], best[split]]
            sums[child] = s.reshape(wide, -1)[rows[split], best[split]]
        moving = on[feature[node[on]] >= 0]
        at = node[moving]
        node[moving] = 2 * at + 1 + (bins[moving, feature[at]] > cut[at])
    value = np.divide(sums, count, out=np.zeros(size), where=count > 0)
    return Tree(feature, cut, value)


def fit_predict(
    bins: np.ndarray, n: np.ndarray, total: np.ndarray, asked: np.ndarray, spec: TreeSpec
) -> np.ndarray:
    """Predictions for the rows ``asked`` (bins) of trees fitted to the cells.

    Boosting starts from the mean; each tree is fitted to what is left over."""
    if spec.trees == 1:
        return grow(bins, n, total, spec).predict(asked)
    start = total.sum() / n.sum()
    left, out = total - n * start, np.full(len(asked), start)
    for _ in range(spec.trees):
        tree = grow(bins, n, left, spec)
        left = left - n * spec.rate * tree.predict(bins)
        out += spec.rate * tree.predict(asked)
    return out
