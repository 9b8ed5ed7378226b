"""The registered queries: one per operator, over the given parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES
from candlewick.functions.rounding import round_half_even, run_timestamp, sanitize_symbol
from candlewick.operators import backtest as bt
from candlewick.operators import charts, features, inference, models, neural, nonlinear, reports, stats
from candlewick.operators.estimator import LeastSquaresRegressor
from candlewick.operators.features import FEATURES
from candlewick.operators.layout import Layout
from candlewick.plans import workflows
from candlewick.storage import settle
from candlewick.sources.tables import ORDERS, prices, prices_orders, prices_wide, returns

Query = Callable[[SparkSession, str], DataFrame]

# Test rows per series: the default tail on long series, a shorter one on the
# short per-user series, where 30 would leave half of them untested.
LONG_TAIL, SHORT_TAIL = 30, 10
# A price below this counts as missing in the queries about gaps.
GAP_BELOW = 5.0
# Expected mean return in percent used on the lineitem returns.
RETURNS_EXPECTED = 0.05
# Significance level of the reports that need a significant ANOVA on them.
WIDER = 0.1

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int) -> DataFrame:
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(
        *[round_half_even(c, digits).alias(c) if c in doubles else c for c in df.columns]
    )


def _single(name: str) -> Column:
    """Means of cents often end in an exact half at any decimal place; single
    precision compares them without such ties."""
    return F.col(name).cast("float").cast("double").alias(name)


def _gapped(spark: SparkSession, sf: str) -> DataFrame:
    return prices(spark, sf).withColumn("close", F.when(F.col("close") >= GAP_BELOW, F.col("close")))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.rolling_features(prices(spark, sf))


# -- projections and filters -------------------------------------------------------
@query
def filter_symbols(spark, sf):
    chosen = stats.filter_symbols(prices(spark, sf), ["click", "view"])
    return chosen.select("symbol", "event_id", "close")


@query
def filter_invested(spark, sf):
    rows = inference.invested(returns(spark, sf))
    return rounded(rows, 6)


@query
def distinct_symbols(spark, sf):
    return stats.distinct_symbols(prices(spark, sf))


@query
def features_complete_rows(spark, sf):
    rows = features.complete_rows(features.rolling_features(_gapped(spark, sf)))
    return rounded(rows.select("symbol", "event_id", "close", *FEATURES), 4)


@query
def drop_any_null(spark, sf):
    rows = features.rolling_features(_gapped(spark, sf)).dropna()
    return rounded(rows.select("symbol", "event_id", "close"), 4)


@query
def model_matrix(spark, sf):
    return rounded(features.model_matrix(_features(spark, sf)).drop("date"), 4)


@query
def trade_signal(spark, sf):
    rows = features.previous_close(prices(spark, sf)).where(F.col("previous_close").isNotNull())
    signals = bt.trade_signal(rows.withColumn("prediction", F.col("previous_close")))
    return signals.select("symbol", "event_id", "close", "prediction", "investment_made")


@query
def union_by_name(spark, sf):
    both = prices(spark, sf).unionByName(prices_orders(spark, sf), allowMissingColumns=True)
    return both.select("symbol", "event_id", "o_orderkey", "close")


@query
def sanitize_symbols(spark, sf):
    symbol = F.concat(F.col("symbol"), F.lit("/USDT"))
    return prices(spark, sf).select("event_id", sanitize_symbol(symbol).alias("symbol"))


QUERIES["sanitize_symbol"] = QUERIES.pop("sanitize_symbols")


@query
def format_run_timestamp(spark, sf):
    return prices(spark, sf).select("event_id", run_timestamp("date").alias("prefix"))


@query
def round_half_even_values(spark, sf):
    # Eighths of a price hit exact halves.
    eighth = F.col("close") / 8
    return prices(spark, sf).select(
        "event_id",
        round_half_even(eighth, 2).alias("rounded_2"),
        round_half_even(eighth, 4).alias("rounded_4"),
    )


QUERIES["round_half_even"] = QUERIES.pop("round_half_even_values")


# -- statistics --------------------------------------------------------------------
@query
def summary_statistics(spark, sf):
    return stats.summary_statistics(prices(spark, sf))


@query
def dispersion_statistics(spark, sf):
    return stats.dispersion_statistics(prices(spark, sf))


@query
def dispersion_comparison(spark, sf):
    return stats.dispersion_comparison(prices(spark, sf))


@query
def volatility_ranking(spark, sf):
    return stats.volatility_ranking(prices(spark, sf))


@query
def mean_abs_deviation(spark, sf):
    table = stats.mean_abs_deviation(prices_wide(spark, sf))
    return table.select("symbol", _single("mean_abs_deviation"))


@query
def compare_variability(spark, sf):
    return rounded(stats.compare_variability(prices_wide(spark, sf)), 6)


@query
def price_trends_monthly(spark, sf):
    trends = stats.price_trends_monthly(prices_orders(spark, sf), ORDERS.order)
    mean = _single("mean")
    exact = [round_half_even(c, 4).alias(c) for c in ("median", "mode", "close")]
    return trends.select("symbol", "month_year", mean, *exact)


@query
def export_fixed_decimals(spark, sf):
    return reports.fixed_decimals(stats.dispersion_statistics(prices(spark, sf)))


# -- features ------------------------------------------------------------------------
def _feature_columns(rows: DataFrame, key: str) -> DataFrame:
    return rounded(rows.select("symbol", key, "close", *FEATURES), 4)


@query
def features_7d(spark, sf):
    return _feature_columns(_features(spark, sf), "event_id")


@query
def features_7d_wide(spark, sf):
    return _feature_columns(features.rolling_features(prices_wide(spark, sf)), "event_id")


@query
def features_7d_tied(spark, sf):
    rows = features.rolling_features(prices_orders(spark, sf), ORDERS)
    return _feature_columns(rows, "o_orderkey")


@query
def features_7d_sliced(spark, sf):
    """The same result with every long series cut into slices, as at scale."""
    source = prices_orders(spark, sf)
    layout = Layout.plan(source, ORDERS.keys, ORDERS.order, limit=max(50, source.count() // 60))
    return _feature_columns(features.rolling_features(source, ORDERS, layout), "o_orderkey")


@query
def return_1d(spark, sf):
    return rounded(_features(spark, sf).select("symbol", "event_id", "return_1d"), 6)


@query
def features_gap_fill(spark, sf):
    filled = features.fill_gaps(_gapped(spark, sf))
    return filled.select("symbol", "event_id", "close", "close_filled")


@query
def features_7d_gaps(spark, sf):
    return _feature_columns(features.rolling_features(_gapped(spark, sf)), "event_id")


@query
def trade_days(spark, sf):
    rows = features.next_close(prices(spark, sf))
    return rows.select("symbol", "event_id", "close", "next_price")


@query
def train_test_split_tail(spark, sf):
    frame = models.test_frame(prices_wide(spark, sf), SHORT_TAIL)
    return frame.select(
        "symbol",
        "event_id",
        F.col("rn").cast("long").alias("rn"),
        F.col("n").cast("long").alias("n"),
        "is_test",
    )


# -- models --------------------------------------------------------------------------
def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.rolling_features(prices(spark, sf), neighbours=True)
    return features.complete_rows(rows).select(
        "symbol", "event_id", "close", "previous_close", *MODEL_FEATURES
    )


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_quality(models.fit_in_sample(_matrix(spark, sf)))


@query
def ols_simple(spark, sf):
    return rounded(models.ols_simple(_matrix(spark, sf)), 6)


@query
def actual_vs_predicted(spark, sf):
    wide = models.fit_in_sample(_matrix(spark, sf))
    return rounded(models.long_predictions(wide, ["symbol", "event_id", "close"]), 4)


@query
def model_rmse(spark, sf):
    return rounded(_quality(spark, sf).select("strategy", "n", "mse", "rmse"), 6)


@query
def model_r2(spark, sf):
    return rounded(_quality(spark, sf).select("strategy", "r2"), 6)


@query
def model_correlation(spark, sf):
    return rounded(_quality(spark, sf).select("strategy", "correlation"), 6)


@query
def best_model(spark, sf):
    best = _quality(spark, sf).where(F.col("strategy") == F.col("best"))
    return rounded(best.select("strategy", F.col("r2").alias("score")), 6)


@query
def rmse_vs_best(spark, sf):
    q = _quality(spark, sf).select("strategy", "best", "rmse_vs_best", "identical_to_best")
    return rounded(q, 6)


@query
def kfold_rmse(spark, sf):
    fold = models.fold_of("event_id")
    return rounded(models.kfold_simple(_matrix(spark, sf), models.SIMPLE_STRATEGIES, fold), 6)


@query
def kfold_linear(spark, sf):
    scored = models.kfold_polynomial(_matrix(spark, sf), (1, 2), models.fold_of("event_id"))
    return rounded(scored.drop("degree", "r2"), 4)


@query
def ols_in_sample(spark, sf):
    matrix = _matrix(spark, sf)
    wide = models.fit_models(matrix, models.pipelines((1,)))
    return rounded(models.long_predictions(wide, ["symbol", "event_id", "close"]), 4)


@query
def poly_regression(spark, sf):
    return rounded(models.in_sample_polynomial(_matrix(spark, sf), (2, 3)), 3)


@query
def poly_regression_all(spark, sf):
    """Every default degree; the oracle of ``poly_regression`` covers two of them."""
    return rounded(models.in_sample_polynomial(_matrix(spark, sf), degrees=(1, 2, 3, 4, 5)), 3)


@query
def kfold_polynomial_all(spark, sf):
    scored = models.kfold_polynomial(
        _matrix(spark, sf), (1, 2, 3, 4, 5), models.fold_of("event_id")
    )
    return rounded(scored.drop("r2"), 4)


@query
def kfold_mean_absolute(spark, sf):
    scored = models.kfold_absolute(_matrix(spark, sf), (1, 2), models.fold_of("event_id"))
    return rounded(scored, 4)


@query
def tree_regressor(spark, sf):
    matrix = models.dealt(_matrix(spark, sf))
    trees = {
        name: models.tree_pipeline(name, **params)
        for name, params in (
            ("DecisionTreeRegressor", {}),
            ("RandomForestRegressor", {"numTrees": 20}),
            ("GradientBoostingRegressor", {}),
        )
    }
    return rounded(models.in_sample_quality(matrix, trees), 6)


@query
def model_comparison(spark, sf):
    scored = workflows.compare_models(prices(spark, sf), trees=("DecisionTreeRegressor",))
    return rounded(scored, 4)


@query
def model_quality(spark, sf):
    return rounded(workflows.model_quality(prices(spark, sf)), 4)


@query
def walk_forward_simple(spark, sf):
    history = models.fold_history(models.test_frame(prices_wide(spark, sf), SHORT_TAIL))
    out = models.walk_forward_simple(history)
    return rounded(out.select("symbol", "event_id", "close", "strategy", "prediction"), 4)


@query
def walk_forward_linear(spark, sf):
    history = models.fold_history(models.test_frame(prices_wide(spark, sf), SHORT_TAIL))
    out = models.walk_forward_polynomial(history, (1,))
    return rounded(out.select("symbol", "event_id", "close", "strategy", "prediction"), 3)


@query
def walk_forward_polynomial(spark, sf):
    history = models.fold_history(models.test_frame(prices(spark, sf), LONG_TAIL), degree=2)
    out = models.walk_forward_polynomial(history, (1, 2))
    return rounded(out.select("symbol", "event_id", "close", "strategy", "prediction"), 2)


def _stepwise(source: DataFrame, tail_rows: int, trees: tuple[str, ...]) -> DataFrame:
    history = nonlinear.binned_history(models.test_frame(source, tail_rows))
    out = nonlinear.walk_forward_trees(history, trees)
    return out.select("symbol", "event_id", "close", "strategy", "prediction")


@query
def walk_forward_stump(spark, sf):
    return rounded(_stepwise(prices_wide(spark, sf), SHORT_TAIL, ("DecisionStump",)), 9)


@query
def walk_forward_trees(spark, sf):
    """Deep and boosted trees; the oracle of ``walk_forward_stump`` covers one split."""
    trees = ("DecisionTreeRegressor", "GradientBoostingRegressor")
    return rounded(_stepwise(prices(spark, sf), LONG_TAIL, trees), 2)


# -- neural regressor, estimator -----------------------------------------------------
@query
def neural_regressor(spark, sf):
    return rounded(neural.in_sample_neural(_matrix(spark, sf)), 3)


@query
def kfold_neural(spark, sf):
    return rounded(neural.kfold_neural(_matrix(spark, sf), models.fold_of("event_id"), 5), 3)


@query
def estimator_in_sample(spark, sf):
    """The linear model as a fitted Spark ML stage."""
    matrix = _matrix(spark, sf)
    fitted = LeastSquaresRegressor().fit(matrix).transform(matrix)
    return rounded(fitted.select("symbol", "event_id", "close", F.lit("LinearRegression").alias("strategy"), "prediction"), 4)


# -- backtest ------------------------------------------------------------------------
def _predicted(source: DataFrame, tail_rows: int) -> tuple[DataFrame, DataFrame]:
    """Predictions of the naive and the one-feature strategies, and the tail."""
    return workflows.predict(source, (), simple=True, test_days=tail_rows)


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return bt.backtest_days(*_predicted(prices(spark, sf), LONG_TAIL))


def _daily_wide(spark: SparkSession, sf: str) -> DataFrame:
    return bt.backtest_days(*_predicted(prices_wide(spark, sf), SHORT_TAIL))


@query
def direction_accuracy(spark, sf):
    predicted, _ = _predicted(prices_wide(spark, sf), SHORT_TAIL)
    return rounded(models.direction_accuracy(predicted), 6)


@query
def backtest_daily(spark, sf):
    return _daily(spark, sf)


@query
def backtest_daily_wide(spark, sf):
    return _daily_wide(spark, sf).drop("date", "event_id")


@query
def backtest_consolidated(spark, sf):
    return bt.consolidated(*_predicted(prices_wide(spark, sf), SHORT_TAIL))


@query
def buy_and_hold(spark, sf):
    _, tail = _predicted(prices_wide(spark, sf), SHORT_TAIL)
    return bt.hold_days(tail).drop("date")


@query
def capital_curve(spark, sf):
    curve = bt.capital_curve(*_predicted(prices(spark, sf), LONG_TAIL))
    return rounded(curve.drop("date"), 4)


@query
def backtest_end_to_end(spark, sf):
    trees = ("GradientBoostingRegressor",)
    results = workflows.backtest(prices(spark, sf), simple=True, trees=trees)
    return results["consolidated"]


# -- tests on returns ----------------------------------------------------------------
def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return inference.combo_statistics(inference.invested(returns(spark, sf)))


def _backtest_stats(spark: SparkSession, sf: str) -> DataFrame:
    # Reports read these few rows several times; store them once.
    return settle(inference.combo_statistics(inference.invested(_daily(spark, sf))))


@query
def invested_counts(spark, sf):
    return inference.invested_counts(returns(spark, sf))


@query
def combo_metrics(spark, sf):
    return rounded(inference.combo_metrics(_stats(spark, sf)), 6)


@query
def combo_median_split(spark, sf):
    split = None
    for criterion in inference.SPLITS:
        part = inference.median_split(_stats(spark, sf), criterion).select(
            F.lit(criterion).alias("criterion"), "symbol", "strategy", "metric", "median", "group_name"
        )
        split = part if split is None else split.unionByName(part)
    return rounded(split, 6)


@query
def group_members(spark, sf):
    members = inference.group_members(_stats(spark, sf), "mean_return")
    return members.select("group_name", F.array_join("members", ", ").alias("members"))


@query
def anova_groups_rows(spark, sf):
    facts = inference.invested(returns(spark, sf))
    rows = inference.grouped_rows(facts, inference.combo_statistics(facts), "volatility")
    return rounded(rows, 6)


@query
def ttest_one_sample(spark, sf):
    return rounded(inference.ttest_one_sample(_stats(spark, sf), RETURNS_EXPECTED), 6)


@query
def ttest_backtest(spark, sf):
    daily = inference.invested(_daily_wide(spark, sf))
    return rounded(inference.ttest_one_sample(inference.combo_statistics(daily)), 6)


@query
def anova_individual(spark, sf):
    return rounded(inference.anova_individual(_stats(spark, sf)), 6)


@query
def anova_by_volatility(spark, sf):
    return rounded(inference.anova_grouped(_stats(spark, sf), "volatility"), 6)


@query
def anova_by_mean_return(spark, sf):
    return rounded(inference.anova_grouped(_stats(spark, sf), "mean_return"), 6)


@query
def anova_by_frequency(spark, sf):
    return rounded(inference.anova_grouped(_stats(spark, sf), "investment_frequency"), 6)


@query
def pairwise_ttest(spark, sf):
    pairs = inference.posthoc_individual(_stats(spark, sf))
    return rounded(pairs.drop("ord1", "ord2", "df"), 6)


@query
def posthoc_summary(spark, sf):
    return rounded(reports.posthoc_summary(_backtest_stats(spark, sf), "mean_return"), 6)


@query
def export_ttest_report(spark, sf):
    return reports.ttest_report(_stats(spark, sf), RETURNS_EXPECTED)


@query
def export_posthoc_individual(spark, sf):
    return reports.posthoc_report(settle(_stats(spark, sf)), WIDER)


@query
def report_anova_individual(spark, sf):
    return reports.anova_individual_report(settle(_stats(spark, sf)), WIDER)


@query
def report_anova_grouped(spark, sf):
    return reports.anova_grouped_report(_backtest_stats(spark, sf), "mean_return")


@query
def report_posthoc_grouped(spark, sf):
    return reports.posthoc_grouped_report(_backtest_stats(spark, sf), "mean_return")


@query
def report_posthoc_volatility(spark, sf):
    return reports.posthoc_grouped_report(_backtest_stats(spark, sf), "volatility")


@query
def analysis_overview(spark, sf):
    return rounded(workflows.analysis_overview(returns(spark, sf), RETURNS_EXPECTED), 6)


# -- charts --------------------------------------------------------------------------
@query
def boxplot_stats(spark, sf):
    return rounded(charts.boxplot_statistics(prices_wide(spark, sf)), 4)


@query
def histogram_20(spark, sf):
    return rounded(charts.histogram(prices(spark, sf)), 6)


@query
def variability_normalized(spark, sf):
    return rounded(charts.variability_normalized(prices_wide(spark, sf)), 6)


@query
def radar_metrics(spark, sf):
    return rounded(charts.radar_metrics(prices_wide(spark, sf)), 6)
