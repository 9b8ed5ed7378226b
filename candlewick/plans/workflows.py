"""Composite entry points: load, describe, compare models, backtest, analyse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.config import (
    EXPECTED_RETURN,
    FOLDS,
    GROUPING_CRITERIA,
    INITIAL_CAPITAL,
    MIN_TRAIN_ROWS,
    POLYNOMIAL_DEGREES,
    SIGNIFICANCE,
    TEST_DAYS,
    SeriesSpec,
)
from candlewick.operators import backtest as bt
from candlewick.operators import charts, inference, models, nonlinear, reports, stats
from candlewick.operators.features import model_matrix, rolling_features
from candlewick.storage import settle
from candlewick.sources.csv import scan_banner_csv
from candlewick.sources.sinks import write_combined


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def degree_range(low_high: Sequence[int] = POLYNOMIAL_DEGREES) -> tuple[int, ...]:
    return tuple(range(low_high[0], low_high[1] + 1))


def load_prices(
    spark: SparkSession,
    folder: str,
    target: str,
    types: Mapping[str, str] | None = None,
    fmt: str = "parquet",
) -> None:
    """Combine a folder of bannered CSV files into one table."""
    write_combined(scan_banner_csv(spark, folder, types), target, fmt)


def describe(
    prices: DataFrame,
    symbols: Sequence[str] | None = None,
    order: Sequence[str] = ("date", "event_id"),
) -> dict[str, DataFrame]:
    """Every descriptive table.  The per-symbol description is computed and
    stored once; five tables are views of it."""
    chosen = stats.filter_symbols(prices, symbols or None)
    d = settle(stats.describe_symbols(chosen))
    return {
        "summary_statistics": stats.summary_statistics(chosen, described=d),
        "dispersion_statistics": stats.dispersion_statistics(chosen, described=d),
        "dispersion_comparison": stats.dispersion_comparison(chosen, described=d),
        "volatility_ranking": stats.volatility_ranking(chosen, described=d),
        "radar_metrics": charts.radar_metrics(chosen, described=d),
        "histogram": charts.histogram(chosen),
        "boxplot": charts.boxplot_statistics(chosen),
        "variability": stats.compare_variability(chosen),
        "variability_normalized": charts.variability_normalized(chosen),
        "price_trends_monthly": stats.price_trends_monthly(chosen, order),
    }


METRICS = ("mse", "rmse", "mae", "r2")


def compare_models(
    prices: DataFrame,
    degrees: Sequence[int] = (1, *degree_range()),
    trees: Sequence[str] = ("GradientBoostingRegressor",),
    folds: int = FOLDS,
    spec: SeriesSpec = SeriesSpec(),
    metric: str = "rmse",
) -> DataFrame:
    """Cross-validated errors per model, best first by ``metric``.

    The mean absolute error takes one more pass, so it is given for ``mae`` only.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    matrix = model_matrix(rolling_features(prices, spec), spec)
    fold = models.hashed_fold(*spec.keys, *spec.order, folds=folds)
    scored = models.kfold_polynomial(matrix, degrees, fold).drop("degree")
    if metric == "mae":
        scored = scored.join(models.kfold_absolute(matrix, degrees, fold), "strategy")
    parts = [scored]
    if trees:
        # Tree fits read the rows many times.
        matrix = models.dealt(matrix)
        parts += [
            models.kfold_pipeline(matrix, t, models.tree_pipeline(t), fold, folds).select(scored.columns)
            for t in trees
        ]
    best = F.col(metric).desc_nulls_last() if metric == "r2" else F.col(metric)
    return _union(parts).orderBy(best, "strategy")


def predictions(
    history: DataFrame,
    degrees: Sequence[int] = (1, *degree_range()),
    simple: bool = False,
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """Walk-forward predictions of the test rows in ``history``, which must have
    been folded for the highest of ``degrees``."""
    parts = []
    top = max(degrees, default=1)
    if degrees:
        parts.append(models.walk_forward_polynomial(history, degrees, top, spec))
    if simple:
        parts.append(models.walk_forward_simple(history, top, spec))
        parts.append(models.naive_forecast(history, spec))
    return _union(parts)


def predict(
    prices: DataFrame,
    degrees: Sequence[int] = (1, *degree_range()),
    simple: bool = False,
    test_days: int = TEST_DAYS,
    spec: SeriesSpec = SeriesSpec(),
    target: str = "close",
    min_train: int = MIN_TRAIN_ROWS,
    drop_any: bool = False,
    trees: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(predictions, test rows).  The price history is read once and folded into
    one stored row per series; both results read only that.  Tree regressors read
    it once more, as binned cells."""
    frame = models.test_frame(
        prices, test_days, min_train, spec, target=target, drop_any=drop_any
    )
    history = settle(models.fold_history(frame, max(degrees, default=1), spec))
    tail = models.test_rows(history, spec).select(*spec.keys, *spec.order, spec.value)
    predicted = predictions(history, degrees, simple, spec)
    if trees:
        binned = settle(nonlinear.binned_history(frame, spec))
        predicted = predicted.unionByName(nonlinear.walk_forward_trees(binned, trees, spec))
    return predicted, tail


def backtest(
    prices: DataFrame,
    degrees: Sequence[int] = (1, *degree_range()),
    simple: bool = False,
    test_days: int = TEST_DAYS,
    capital: float = INITIAL_CAPITAL,
    symbols: Sequence[str] | None = None,
    spec: SeriesSpec = SeriesSpec(),
    target: str = "close",
    min_train: int = MIN_TRAIN_ROWS,
    trees: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """All symbols and strategies in one plan; linear, polynomial and the named tree
    models are refitted before each test row."""
    chosen = stats.filter_symbols(prices, symbols or None)
    predicted, tail = predict(
        chosen, degrees, simple, test_days, spec, target, min_train, drop_any=True, trees=trees
    )
    skipped = models.skipped_series(chosen, test_days, min_train, spec, drop_any=True)
    return {
        "predictions": predicted,
        "skipped": skipped,
        "days": bt.backtest_days(predicted, tail, capital, spec),
        "consolidated": bt.consolidated(predicted, tail, capital, spec),
        "capital_curve": bt.capital_curve(predicted, tail, capital, spec),
        "direction": models.direction_accuracy(predicted, spec),
    }


def model_quality(
    prices: DataFrame,
    degrees: Sequence[int] = (1, *degree_range()),
    trees: Sequence[str] = ("GradientBoostingRegressor",),
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """In-sample error, R2, correlation and distance to the best model.  Each
    model is fitted once, and one aggregate gives all figures."""
    matrix = models.dealt(model_matrix(rolling_features(prices, spec), spec))
    wide = models.fit_models(matrix, models.pipelines(degrees, trees))
    return models.fit_quality(wide).drop("ord")


def analyse_returns(
    daily: DataFrame,
    expected_return: float = EXPECTED_RETURN,
    significance: float = SIGNIFICANCE,
    criteria: Sequence[str] = GROUPING_CRITERIA,
) -> dict[str, DataFrame]:
    """All tests and reports on the invested rows; the facts are read once."""
    combos = settle(inference.combo_statistics(inference.invested(daily)))
    out = {
        "ttest": inference.ttest_one_sample(combos, expected_return, significance),
        "ttest_report": reports.ttest_report(combos, expected_return, significance),
        "anova": inference.anova_individual(combos, significance),
        "posthoc": reports.posthoc_report(combos, significance),
        "anova_report": reports.anova_individual_report(combos, significance),
    }
    for c in criteria:
        out[f"anova_{c}"] = inference.anova_grouped(combos, c, significance)
        out[f"members_{c}"] = inference.group_members(combos, c)
        out[f"anova_report_{c}"] = reports.anova_grouped_report(combos, c, significance)
        out[f"posthoc_{c}"] = reports.posthoc_summary(combos, c, significance)
        out[f"posthoc_report_{c}"] = reports.posthoc_grouped_report(combos, c, significance)
    return out


def analysis_overview(
    daily: DataFrame,
    expected_return: float = EXPECTED_RETURN,
    significance: float = SIGNIFICANCE,
    criteria: Sequence[str] = GROUPING_CRITERIA,
) -> DataFrame:
    """One row per analysis: tested groups, test statistic, p-value, verdict."""
    combos = settle(inference.combo_statistics(inference.invested(daily)))
    t = inference.ttest_one_sample(combos, expected_return, significance)
    first = t.agg(
        F.lit("t-test").alias("analysis"),
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("observations"),
        F.min("t_stat").alias("statistic"),
        F.min("p_value").alias("p_value"),
        F.count_if("rejected").alias("significant_results"),
    )

    def row(name: str, anova: DataFrame) -> DataFrame:
        return anova.select(
            F.lit(name).alias("analysis"),
            "groups",
            "observations",
            F.col("f_statistic").alias("statistic"),
            "p_value",
            F.col("is_significant").cast("long").alias("significant_results"),
        )

    rows = [first, row("anova individual", inference.anova_individual(combos, significance))]
    for c in criteria:
        rows.append(row(f"anova {c}", inference.anova_grouped(combos, c, significance)))
    return _union(rows)
