import numpy as np
import pandas as pd
import pytest

from candlewick.operators import features
from helpers import SCHEMA, frame, random_prices, same, series


def by_pandas(rows):
    """Rolling columns per symbol with pandas."""
    out = []
    for _, g in frame(rows).sort_values(["symbol", "date", "event_id"]).groupby("symbol"):
        c = g["close"]
        padded = c.ffill()
        r1 = padded / padded.shift(1) - 1
        out.append(
            g.assign(
                return_1d=r1,
                mean_7d=c.rolling(7).mean(),
                std_7d=c.rolling(7).std(),
                return_7d=padded / padded.shift(7) - 1,
                rolling_max_7d=c.rolling(7).max(),
                rolling_min_7d=c.rolling(7).min(),
                momentum_7d=c - c.shift(7),
                volatility_7d=r1.rolling(7).std(),
            )
        )
    return pd.concat(out)


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_rolling_features_equal_pandas(spark, gaps):
    rows = random_prices([60, 25, 7, 5, 1], gaps=gaps)
    got = features.rolling_features(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["event_id"]: r for r in got}
    want = by_pandas(rows)
    assert len(got) == len(want)
    for _, w in want.iterrows():
        for c in features.FEATURES:
            expected = None if np.isnan(w[c]) else float(w[c])
            assert same(expected, got[w["event_id"]][c], 1e-7), (w["event_id"], c)


def test_zero_price_gives_null_return_and_null_symbol_is_dropped(spark):
    rows = series("A", [1, 0, 5]) + series(None, [1, 2], first_id=10)
    got = features.rolling_features(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["return_1d"] for r in sorted(got, key=lambda r: r["event_id"])] == [None, -1.0, None]


def test_returns_do_not_cross_symbols(spark):
    rows = series("A", [1, 2]) + series("B", [10, 20], first_id=10)
    got = {r["event_id"]: r for r in features.rolling_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10]["return_1d"] is None and got[11]["return_1d"] == 1.0


def test_complete_rows_and_matrix(spark):
    prices = spark.createDataFrame(series("A", range(1, 21)), SCHEMA)
    built = features.rolling_features(prices)
    assert features.complete_rows(built).count() == 13
    assert features.model_matrix(built).columns[-1] == "close"


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="close"):
        features.rolling_features(spark.createDataFrame([("A",)], "symbol string"))


def test_next_close_drops_last_row(spark):
    prices = spark.createDataFrame(series("A", [1, 2, 3]), SCHEMA)
    got = sorted(r["next_price"] for r in features.next_close(prices).collect())
    assert got == [2.0, 3.0]
