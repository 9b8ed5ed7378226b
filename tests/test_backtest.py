import numpy as np
import pytest

from candlewick.operators import backtest as bt
from candlewick.plans import workflows
from helpers import SCHEMA, random_prices, series

PREDICTIONS = SCHEMA + ", strategy string, prediction double"


def case(seed=5, n=12):
    rng = np.random.default_rng(seed)
    prices = np.round(50 + np.cumsum(rng.normal(0, 4, n)), 2)
    predicted = prices + rng.normal(0, 3, n)
    return prices, predicted


def frames(spark, prices, predicted):
    rows = series("A", prices)
    predictions = spark.createDataFrame(
        [(*r, "model", float(p)) for r, p in zip(rows, predicted)], PREDICTIONS
    )
    return predictions, spark.createDataFrame(rows, SCHEMA)


def test_signal_days_equal_a_loop(spark):
    prices, predicted = case()
    predictions, _ = frames(spark, prices, predicted)
    got = sorted(bt.signal_days(predictions).collect(), key=lambda r: r["event_id"])
    capital = 1000.0
    assert len(got) == len(prices) - 1
    for i, r in enumerate(got):
        buy = predicted[i] > prices[i]
        rate = (prices[i + 1] - prices[i]) / prices[i] if buy else 0.0
        after = capital * (1 + rate)
        assert r["investment_made"] == ("Yes" if buy else "No")
        assert r["capital_before"] == pytest.approx(round(capital, 2), abs=0.0101)
        assert r["capital_invested"] == (r["capital_before"] if buy else 0.0)
        assert r["capital_after"] == pytest.approx(round(after, 2), abs=0.0101)
        assert r["capital_gained"] == pytest.approx(after - capital, abs=0.0101)
        assert r["return_pct"] == pytest.approx(rate, abs=6e-5)
        capital = after


def test_consolidated_uses_unrounded_capital(spark):
    prices, predicted = case(8)
    predictions, tail = frames(spark, prices, predicted)
    got = {r["strategy"]: r for r in bt.consolidated(predictions, tail).collect()}
    factors = [prices[i + 1] / prices[i] for i in range(len(prices) - 1) if predicted[i] > prices[i]]
    assert got["model"]["final_value"] == pytest.approx(1000 * np.prod(factors), abs=0.006)
    hold = got[bt.BUY_AND_HOLD]
    assert hold["final_value"] == pytest.approx(1000 * prices[-1] / prices[0], abs=0.006)
    for r in got.values():
        assert r["return_pct"] == pytest.approx(r["final_value"] / 1000 - 1, abs=1e-4)


def test_strategy_that_never_buys(spark):
    predictions, tail = frames(spark, [10, 11, 12], [0, 0, 0])
    days = bt.signal_days(predictions).collect()
    assert {r["investment_made"] for r in days} == {"No"}
    assert all(r["return_pct"] == 0.0 and r["capital_after"] == 1000.0 for r in days)
    final = {r["strategy"]: r["final_value"] for r in bt.consolidated(predictions, tail).collect()}
    assert final["model"] == 1000.0


def test_capital_curve_uses_the_next_prediction(spark):
    prices, predicted = case(2)
    predictions, tail = frames(spark, prices, predicted)
    curve = bt.capital_curve(predictions, tail).collect()
    got = [r["capital"] for r in sorted(curve, key=lambda r: r["event_id"]) if r["strategy"] == "model"]
    steps = np.where(predicted[1:] > prices[:-1], prices[1:] / prices[:-1], 1.0)
    assert got == pytest.approx([1000.0, *(1000.0 * np.cumprod(steps))])
    hold = [r["capital"] for r in sorted(curve, key=lambda r: r["event_id"]) if r["strategy"] != "model"]
    assert hold == pytest.approx((1000 * prices / prices[0]).tolist())


def test_whole_backtest(spark):
    prices = spark.createDataFrame(random_prices([150, 120, 30]), SCHEMA)
    out = workflows.backtest(prices, degrees=(1, 2), simple=True, test_days=20)
    days, total = out["days"].collect(), out["consolidated"].collect()
    # Two symbols; the third is too short.  Five models and buy-and-hold.
    assert len(total) == 2 * 6 and len(days) == 2 * 6 * 19
    assert {r["symbol"] for r in total} == {"S0", "S1"}
    only = workflows.backtest(prices, degrees=(1,), test_days=20, symbols=["S1"])
    assert {r["symbol"] for r in only["consolidated"].collect()} == {"S1"}
    ahead = workflows.backtest(prices, degrees=(1,), test_days=20, target="next_close")
    assert ahead["predictions"].count() == 40
