"""Slicing long series must not change any result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.config import SeriesSpec
from candlewick.operators.distribution import describe_values
from candlewick.operators.features import fill_gaps, next_close, previous_close, rolling_features
from candlewick.operators.layout import SLICE, Layout
from candlewick.operators.models import fold_history, test_frame as build_test_frame
from helpers import SCHEMA, assert_same_rows, random_prices

SPEC = SeriesSpec()
WHOLE = Layout(SPEC.keys, SPEC.order)
CASES = {
    "plain": dict(lengths=[400, 30, 9]),
    "gaps": dict(lengths=[400, 30, 9], gaps=0.3),
    "long gaps": dict(lengths=[300, 40], gaps=0.9),
    "tied dates": dict(lengths=[400, 60], distinct_dates=5),
    "one date": dict(lengths=[300], distinct_dates=1),
}


@pytest.fixture(params=CASES, scope="module")
def prices(request, spark):
    return spark.createDataFrame(random_prices(**CASES[request.param]), SCHEMA).persist()


@pytest.mark.parametrize("limit", [5, 37])
def test_rolling_features(prices, limit):
    layout = Layout.plan(prices, SPEC.keys, SPEC.order, limit=limit)
    assert layout.split
    sliced = rolling_features(prices, SPEC, layout)
    assert_same_rows(
        rolling_features(prices, SPEC, WHOLE).collect(), sliced.collect(), ["symbol", "event_id"]
    )


def test_slices_are_small_and_ordered(prices):
    limit = 40
    layout = Layout.plan(prices, SPEC.keys, SPEC.order, limit=limit)
    tagged = layout.tag(prices)
    largest = tagged.groupBy("symbol", SLICE).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * limit
    rows = tagged.orderBy("symbol", "date", "event_id").collect()
    for a, b in zip(rows, rows[1:]):
        assert a["symbol"] != b["symbol"] or a[SLICE] <= b[SLICE]


@pytest.mark.parametrize("operator", [fill_gaps, next_close, previous_close])
def test_neighbour_operators(prices, operator):
    layout = Layout.plan(prices, SPEC.keys, SPEC.order, limit=20)
    assert_same_rows(
        operator(prices, SPEC, WHOLE).collect(),
        operator(prices, SPEC, layout).collect(),
        ["symbol", "event_id"],
    )


def test_running_and_totals(prices):
    layout = Layout.plan(prices, SPEC.keys, SPEC.order, limit=20)
    sums = {"upto": F.lit(1), "sofar": F.coalesce(F.col("close"), F.lit(0.0))}
    totals = {"n": ("sum", F.lit(1)), "top": ("max", F.col("close"))}
    assert_same_rows(
        WHOLE.running(prices, sums, totals).collect(),
        layout.running(prices, sums, totals).drop(SLICE).collect(),
        ["symbol", "event_id"],
    )


def test_history_of_sliced_series(spark):
    prices = spark.createDataFrame(random_prices([300, 80]), SCHEMA)
    layout = Layout.plan(prices, SPEC.keys, SPEC.order, limit=25)
    whole = fold_history(build_test_frame(prices, 10, layout=WHOLE), 2).collect()
    sliced = {r["symbol"]: r for r in fold_history(build_test_frame(prices, 10, layout=layout), 2).collect()}
    assert len(whole) == len(sliced) == 2
    for row in whole:
        other = sliced[row["symbol"]]
        assert [r["event_id"] for r in row["rows"]] == [r["event_id"] for r in other["rows"]]
        # Factors of the same rows differ in signs; their products with themselves don't.
        one, two = (np.array(r["factor"]).reshape(int(len(r["factor"]) ** 0.5), -1) for r in (row, other))
        assert (one.T @ one).ravel() == pytest.approx((two.T @ two).ravel(), rel=1e-6, abs=1e-6)


def test_sliced_distribution(spark):
    prices = spark.createDataFrame(random_prices([500, 40]), SCHEMA)
    whole = describe_values(prices, ("symbol",), "close").collect()
    spark.conf.set("spark.candlewick.sliceRows", "30")
    try:
        sliced = describe_values(prices, ("symbol",), "close").collect()
    finally:
        spark.conf.unset("spark.candlewick.sliceRows")
    assert_same_rows(whole, sliced, ["symbol"])
