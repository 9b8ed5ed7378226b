"""Per-symbol summary, dispersion and trend tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.rounding import round_half_even
from candlewick.operators.distribution import describe_values
from candlewick.operators.ordering import numbered


def filter_symbols(df: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Keep the listed symbols; ``None`` keeps everything, an empty list nothing."""
    return df if symbols is None else df.where(F.col("symbol").isin(list(symbols)))


def _chosen(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    # The statistics treat an empty list like None.
    return filter_symbols(df, symbols or None)


def distinct_symbols(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct()


def describe_symbols(prices: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """The unrounded description of each symbol's closes, which the rounded
    tables below are views of; pass it as ``described`` to share one."""
    return describe_values(_chosen(prices, symbols), ("symbol",), "close")


def _r2(c: Column | str) -> Column:
    return round_half_even(c, 2)


def summary_statistics(
    prices: DataFrame,
    symbols: Sequence[str] | None = None,
    described: DataFrame | None = None,
) -> DataFrame:
    d = described if described is not None else describe_symbols(prices, symbols)
    return d.select(
        "symbol",
        _r2("mean").alias("mean"),
        _r2("median").alias("median"),
        _r2("mode").alias("mode"),
        _r2("low").alias("min"),
        _r2("high").alias("max"),
    )


def _cv(std_dev: Column, mean: Column) -> Column:
    return _r2(F.try_divide(std_dev, mean) * 100)


def dispersion_statistics(
    prices: DataFrame,
    symbols: Sequence[str] | None = None,
    described: DataFrame | None = None,
) -> DataFrame:
    """The coefficient of variation divides by the unrounded mean here."""
    d = described if described is not None else describe_symbols(prices, symbols)
    q1, q3, sd = _r2("q1"), _r2("q3"), _r2("std_dev")
    return d.select(
        "symbol",
        sd.alias("std_dev"),
        _r2("variance").alias("variance"),
        _cv(sd, F.col("mean")).alias("coef_variation"),
        _r2(F.col("high") - F.col("low")).alias("range"),
        q1.alias("q1"),
        q3.alias("q3"),
        _r2(q3 - q1).alias("iqr"),
    )


def dispersion_comparison(
    prices: DataFrame,
    symbols: Sequence[str] | None = None,
    described: DataFrame | None = None,
) -> DataFrame:
    """Dispersion side by side, most volatile first; this CV divides by the
    rounded mean."""
    d = described if described is not None else describe_symbols(prices, symbols)
    q1, q3, sd, mean = _r2("q1"), _r2("q3"), _r2("std_dev"), _r2("mean")
    iqr = _r2(q3 - q1)
    return d.select(
        "symbol",
        sd.alias("desvio_padrao"),
        _r2("variance").alias("variancia"),
        _cv(sd, mean).alias("coef_variacao"),
        _r2(F.col("high") - F.col("low")).alias("amplitude"),
        iqr.alias("amplitude_interquartil"),
        _r2(iqr / 2).alias("semi_iqr"),
        _r2("mad").alias("desvio_medio_absoluto"),
        mean.alias("media"),
        q1.alias("q1"),
        q3.alias("q3"),
    ).orderBy(F.col("coef_variacao").desc_nulls_last(), "symbol")


def mean_abs_deviation(prices: DataFrame) -> DataFrame:
    d = describe_symbols(prices)
    return d.select("symbol", F.col("mad").alias("mean_abs_deviation"))


def volatility_ranking(prices: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """Positions by falling coefficient of variation; equal ones share a rank."""
    table = dispersion_comparison(prices, described=described)
    table = table.select("symbol", "coef_variacao", "desvio_padrao")
    order = [F.col("coef_variacao").desc_nulls_last(), F.col("symbol")]
    placed = numbered(table, order, "position")
    ranks = placed.groupBy(F.col("coef_variacao").alias("__cv")).agg(F.min("position").alias("rank"))
    same = F.col("coef_variacao").eqNullSafe(F.col("__cv"))
    return placed.join(ranks, same).select(
        "symbol", "coef_variacao", "desvio_padrao", "position", "rank"
    )


def compare_variability(prices: DataFrame) -> DataFrame:
    present = prices.where(F.col("symbol").isNotNull())
    return present.groupBy("symbol").agg(F.stddev_samp("close").alias("variability"))


def price_trends_monthly(
    prices: DataFrame, order: Sequence[str] = ("date", "event_id")
) -> DataFrame:
    """Mean, median, mode and last close per symbol and month."""
    monthly = prices.withColumn("month", F.date_trunc("month", F.col("date")))
    keys = ("symbol", "month")
    known = F.when(F.col("close").isNotNull(), F.struct(*order))
    last = (
        monthly.where(F.col("symbol").isNotNull() & F.col("month").isNotNull())
        .groupBy(*keys)
        .agg(F.max_by("close", known).alias("close"))
    )
    stats = describe_values(monthly, keys, "close").select(*keys, "mean", "median", "mode")
    return last.join(stats, list(keys), "left").select(
        "symbol",
        F.date_format("month", "yyyy-MM").alias("month_year"),
        "mean",
        "median",
        "mode",
        "close",
    )
