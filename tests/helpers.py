"""Small random price tables and row comparison."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd

SCHEMA = "symbol string, date timestamp, event_id long, close double"
START = dt.datetime(2024, 1, 1)


def series(symbol, closes, first_id=0, step=dt.timedelta(days=1)):
    return [
        (symbol, START + i * step, first_id + i, None if c is None else float(c))
        for i, c in enumerate(closes)
    ]


def random_prices(lengths, seed=1, gaps=0.0, distinct_dates=None):
    """Random walks; ``distinct_dates`` makes many rows share a date."""
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        walk = 100 + np.cumsum(rng.normal(0, 3, n)) + 50 * s
        for i, c in enumerate(np.round(np.abs(walk) + 1, 2)):
            day = i if distinct_dates is None else i * distinct_dates // n
            close = None if rng.random() < gaps else float(c)
            rows.append((f"S{s}", START + dt.timedelta(days=day), len(rows), close))
    return rows


def same(a, b, tolerance=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None:
        return False
    if isinstance(a, float) or isinstance(b, float):
        return a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))
    return a == b


def assert_same_rows(left, right, keys, tolerance=1e-9):
    left = {tuple(r[k] for k in keys): r.asDict() for r in left}
    right = {tuple(r[k] for k in keys): r.asDict() for r in right}
    assert left.keys() == right.keys()
    for k, row in left.items():
        for c, v in row.items():
            assert same(v, right[k][c], tolerance), (k, c, v, right[k][c])


def frame(rows):
    return pd.DataFrame(rows, columns=["symbol", "date", "event_id", "close"]).astype(
        {"close": float}
    )
