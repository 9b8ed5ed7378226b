import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions.rounding import fixed, round_half_even, run_timestamp, sanitize_symbol
from candlewick.operators import charts, reports, stats
from candlewick.operators.distribution import describe_values
from helpers import SCHEMA, frame, random_prices, series


def test_summary_of_two_symbols(spark):
    prices = spark.createDataFrame(series("BTC", [100, 200]) + series("ETH", [300, 400]), SCHEMA)
    got = {r["symbol"]: r for r in stats.summary_statistics(prices).collect()}
    assert got["BTC"]["mean"] == 150.0 and got["ETH"]["mean"] == 350.0
    assert got["BTC"]["mode"] == 100.0  # all tie: the smallest


def test_description_equals_numpy(spark):
    rows = random_prices([101, 50, 4, 1], gaps=0.1)
    data = frame(rows)
    got = {r["symbol"]: r for r in describe_values(spark.createDataFrame(rows, SCHEMA), ("symbol",), "close").collect()}
    for symbol, g in data.dropna().groupby("symbol"):
        c, r = g["close"], got[symbol]
        assert r["n"] == len(c)
        assert r["mean"] == pytest.approx(c.mean())
        assert r["median"] == pytest.approx(c.median())
        assert r["mode"] == c.mode().iloc[0]
        assert (r["low"], r["high"]) == (c.min(), c.max())
        assert r["q1"] == pytest.approx(np.percentile(c, 25))
        assert r["q3"] == pytest.approx(np.percentile(c, 75))
        assert r["mad"] == pytest.approx(np.abs(c - c.mean()).mean())
        if len(c) > 1:
            assert r["std_dev"] == pytest.approx(c.std())
        else:
            assert r["std_dev"] is None


@pytest.fixture()
def small_slices(spark):
    spark.conf.set("spark.candlewick.sliceRows", "50")
    yield
    spark.conf.unset("spark.candlewick.sliceRows")


def _hard_groups():
    """Ties, infinities, far magnitudes, neighbouring doubles, signed zeros."""
    rng = np.random.default_rng(5)
    made = {
        "ties": rng.integers(0, 4, 400).astype(float),
        "even": np.repeat(np.arange(60.0), 4)[rng.permutation(240)],
        "distinct": rng.normal(size=501),
        "far": np.concatenate([2.0 ** -np.arange(0, 1070, 3), -(2.0 ** np.arange(0, 1020, 3))]),
        "near": np.nextafter(1.0, 2.0) ** rng.integers(0, 90, 300),
        "tiny": rng.integers(0, 90, 301) * 5e-324,
        "ends": np.concatenate([[-np.inf] * 90, [np.inf] * 70, [1.7e308, -1.7e308], rng.normal(size=120)]),
        "zeros": np.concatenate([[0.0, -0.0] * 60, [1.0] * 100, [-1.0] * 119]),
        "one": np.array([3.0]),
        "two": np.array([1.0, 2.0]),
        "same": np.full(200, 7.0),
    }
    return {k: v[rng.permutation(len(v))] for k, v in made.items()}


def test_large_tables_equal_numpy_and_counted_values(spark, small_slices):
    groups = _hard_groups()
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    rows += [("ties", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "symbol string, close double").repartition(7)
    got = {r["symbol"]: r for r in describe_values(df, ("symbol",), "close").collect()}
    assert set(got) == set(groups)
    spark.conf.set("spark.candlewick.sliceRows", "1000000")
    want = {r["symbol"]: r for r in describe_values(df, ("symbol",), "close").collect()}
    for k, values in groups.items():
        r, w = got[k].asDict(), want[k].asDict()
        ordered = np.sort(values)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            at = (len(values) - 1) * p
            assert r[name] == w[name] or np.isnan(r[name]) and np.isnan(w[name]), (k, name)
            assert at != int(at) or r[name] == ordered[int(at)]
        names, times = np.unique(values, return_counts=True)
        assert r["mode"] == names[np.argmax(times)] == w["mode"], k
        assert (r["n"], r["low"], r["high"]) == (len(values), ordered[0], ordered[-1])
        for name in ("mean", "mad", "std_dev"):
            if w[name] is None or r[name] is None:
                assert r[name] is w[name]
            else:
                assert r[name] == pytest.approx(w[name], rel=1e-9, nan_ok=True), (k, name)


def test_charts_of_large_tables(spark, small_slices):
    prices = spark.createDataFrame(random_prices([301, 120, 80], gaps=0.05), SCHEMA)
    large = [sorted(map(tuple, f(prices).collect())) for f in (charts.histogram, charts.boxplot_statistics)]
    monthly = sorted(map(tuple, stats.price_trends_monthly(prices).collect()))
    spark.conf.unset("spark.candlewick.sliceRows")
    assert large == [sorted(map(tuple, f(prices).collect())) for f in (charts.histogram, charts.boxplot_statistics)]
    small = sorted(map(tuple, stats.price_trends_monthly(prices).collect()))
    assert len(monthly) == len(small)
    for one, two in zip(monthly, small, strict=True):
        assert one[:2] == two[:2] and one[2:] == pytest.approx(two[2:])


def test_two_ways_to_round_the_variation(spark):
    # std 0.57 over 0.504 and over 0.50: the unrounded and the rounded mean.
    values = [0.1, 0.2, 0.3, 0.4, 1.52]
    prices = spark.createDataFrame(series("XRP", values), SCHEMA)
    sd = round(float(np.std(values, ddof=1)), 2)
    mean = float(np.mean(values))
    unrounded = stats.dispersion_statistics(prices).first()["coef_variation"]
    rounded = stats.dispersion_comparison(prices).first()["coef_variacao"]
    assert unrounded == pytest.approx(round(sd / mean * 100, 2))
    assert rounded == pytest.approx(round(sd / round(mean, 2) * 100, 2))
    assert unrounded != rounded


def test_relations_between_measures(spark):
    prices = spark.createDataFrame(random_prices([80, 33]), SCHEMA)
    for r in stats.dispersion_comparison(prices).collect():
        assert r["amplitude_interquartil"] == pytest.approx(r["q3"] - r["q1"], abs=1e-9)
        assert r["semi_iqr"] == pytest.approx(r["amplitude_interquartil"] / 2, abs=0.00501)


def test_constant_series_and_zero_mean(spark):
    rows = series("K", [5] * 8) + series("Z", [-1, 1], first_id=20)
    prices = spark.createDataFrame(rows, SCHEMA)
    got = {r["symbol"]: r for r in stats.dispersion_statistics(prices).collect()}
    assert got["K"]["std_dev"] == 0.0 and got["K"]["coef_variation"] == 0.0
    assert got["Z"]["coef_variation"] is None
    bins = [r for r in charts.histogram(prices).collect() if r["symbol"] == "K"]
    assert sum(r["n"] for r in bins) == 8 and len(bins) == 20


def test_symbol_filters(spark):
    prices = spark.createDataFrame(series("A", [1]) + series("B", [2]), SCHEMA)
    assert stats.filter_symbols(prices).count() == 2
    assert stats.filter_symbols(prices, ["A"]).count() == 1
    assert stats.filter_symbols(prices, []).count() == 0
    assert stats.summary_statistics(prices, []).count() == 2
    assert stats.summary_statistics(prices, ["X"]).count() == 0


def test_histogram_equals_numpy(spark):
    rows = random_prices([200])
    counts, edges = np.histogram([r[3] for r in rows], bins=20)
    got = sorted(charts.histogram(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["bin"])
    assert [r["n"] for r in got] == counts.tolist()
    assert [r["bin_lo"] for r in got] == pytest.approx(edges[:-1].tolist())


def test_boxplot_outliers(spark):
    prices = spark.createDataFrame(series("A", [1, 2, 3, 4, 5, 100]), SCHEMA)
    box = charts.boxplot_statistics(prices).first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 5.0, 1)


def test_monthly_close_is_the_last_by_order(spark):
    prices = spark.createDataFrame(series("A", [1, 2, None]), SCHEMA)
    row = stats.price_trends_monthly(prices).first()
    assert (row["month_year"], row["close"], row["mean"]) == ("2024-01", 2.0, 1.5)


def test_rounding_and_text(spark):
    row = spark.range(1).select(
        round_half_even(F.lit(0.125), 2).alias("half"),
        round_half_even(F.lit(95.365), 2).alias("semi"),
        fixed(F.lit(1234.5), 2).alias("text"),
        fixed(F.lit(float("inf")), 4).alias("inf"),
        fixed(F.lit(None).cast("double"), 2).alias("none"),
        sanitize_symbol(F.lit("BTC/USDT")).alias("symbol"),
        run_timestamp(F.lit("2024-03-05 06:07:08").cast("timestamp")).alias("prefix"),
    ).first()
    assert row.asDict() == {
        "half": 0.12,
        "semi": float(np.round(95.365, 2)),
        "text": "1234.50",
        "inf": "inf",
        "none": None,
        "symbol": "BTC_USDT",
        "prefix": "20240305_0607",
    }
    table = spark.createDataFrame([("a", 1.5, 2)], "s string, d double, i int")
    assert reports.fixed_decimals(table).first().asDict() == {"s": "a", "d": "1.50", "i": 2}
