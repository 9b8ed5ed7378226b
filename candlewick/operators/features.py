"""Seven-row rolling features of ordered price series.

Differences from a naive whole-table computation, all deliberate: returns never
cross from one symbol into the next, and the row order is always explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.config import MODEL_FEATURES, ROLLING_ROWS, SeriesSpec
from candlewick.operators.layout import SLICE, Layout

FEATURES = (
    "return_1d",
    "mean_7d",
    "std_7d",
    "return_7d",
    "rolling_max_7d",
    "rolling_min_7d",
    "momentum_7d",
    "volatility_7d",
)
_FILLED = "__filled"


def require_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keyed(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Rows that belong to a series; null keys form no group."""
    require_columns(df, (*spec.keys, *spec.order, spec.value))
    for k in spec.keys:
        df = df.where(F.col(k).isNotNull())
    return df


def series_layout(df: DataFrame, spec: SeriesSpec = SeriesSpec()) -> Layout:
    slim = keyed(df, spec).select(*spec.keys, *spec.order)
    return Layout.plan(slim, spec.keys, spec.order, upper_bound=df.count)


def _ratio_change(now, before):
    return F.try_divide(now, before) - 1


def rolling_features(
    prices: DataFrame,
    spec: SeriesSpec = SeriesSpec(),
    layout: Layout | None = None,
    keep_slice: bool = False,
    neighbours: bool = False,
) -> DataFrame:
    """Add the eight rolling columns, and with ``neighbours`` the columns
    ``previous_close`` and ``next_close`` of the adjacent rows.

    A rolling statistic needs seven non-null values in its frame.  The two
    returns look through gaps by carrying the last known price forward.
    """
    n = ROLLING_ROWS
    prices = keyed(prices, spec)
    layout = layout or series_layout(prices, spec)
    close = F.col(spec.value)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-(n - 1), 0)
        filled = F.col(_FILLED)
        full = F.count(close).over(frame) == n
        if _FILLED not in df.columns:
            so_far = w.rowsBetween(W.unboundedPreceding, 0)
            df = df.withColumn(_FILLED, F.last(close, ignorenulls=True).over(so_far))
        df = df.withColumns(
            {
                "return_1d": _ratio_change(filled, F.lag(filled).over(w)),
                "mean_7d": F.when(full, F.avg(close).over(frame)),
                "std_7d": F.when(full, F.stddev_samp(close).over(frame)),
                "return_7d": _ratio_change(filled, F.lag(filled, n).over(w)),
                "rolling_max_7d": F.when(full, F.max(close).over(frame)),
                "rolling_min_7d": F.when(full, F.min(close).over(frame)),
                "momentum_7d": close - F.lag(close, n).over(w),
            }
        )
        if neighbours:
            df = df.withColumns(
                {"previous_close": F.lag(close).over(w), "next_close": F.lead(close).over(w)}
            )
        steady = F.count("return_1d").over(frame) == n
        return df.withColumn(
            "volatility_7d", F.when(steady, F.stddev_samp("return_1d").over(frame))
        ).drop(_FILLED)

    if layout.split:
        # A gap may be longer than the rows shared between slices, so gaps are
        # filled over the whole series first; without any there is nothing to do.
        if prices.where(close.isNull()).isEmpty():
            prices = prices.withColumn(_FILLED, close)
        else:
            prices = layout.fill_forward(prices, spec.value, _FILLED)
    out = layout.lookaround(prices, build, back=n, ahead=1 if neighbours else 0)
    return out if keep_slice else out.drop(SLICE)


def fill_gaps(
    prices: DataFrame, spec: SeriesSpec = SeriesSpec(), layout: Layout | None = None
) -> DataFrame:
    prices = keyed(prices, spec)
    layout = layout or series_layout(prices, spec)
    return layout.fill_forward(prices, spec.value, "close_filled").drop(SLICE)


def next_close(
    prices: DataFrame, spec: SeriesSpec = SeriesSpec(), layout: Layout | None = None
) -> DataFrame:
    """Rows with the following price; the last row of a series is dropped."""
    prices = keyed(prices, spec)
    layout = layout or series_layout(prices, spec)
    out = layout.lookaround(
        prices, lambda df, w: df.withColumn("next_price", F.lead(spec.value).over(w)), ahead=1
    )
    return out.where(F.col("next_price").isNotNull()).drop(SLICE)


def previous_close(
    prices: DataFrame, spec: SeriesSpec = SeriesSpec(), layout: Layout | None = None
) -> DataFrame:
    prices = keyed(prices, spec)
    layout = layout or series_layout(prices, spec)
    out = layout.lookaround(
        prices, lambda df, w: df.withColumn("previous_close", F.lag(spec.value).over(w)), back=1
    )
    return out.drop(SLICE)


def complete_rows(features: DataFrame) -> DataFrame:
    return features.dropna(subset=list(MODEL_FEATURES))


def model_matrix(features: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Identifiers, the five model features and the target."""
    return complete_rows(features).select(*spec.keys, *spec.order, *MODEL_FEATURES, spec.value)


def with_position(
    df: DataFrame, spec: SeriesSpec, layout: Layout, level: str | None = None
) -> DataFrame:
    """Add ``rn`` (1-based position) and ``n`` (length) of each series, and with
    ``level`` the mean and spread of that column over the series."""
    one = F.lit(1)
    totals = {"n": ("sum", one)}
    if level:
        c = F.col(level)
        totals |= {"__s1": ("sum", c), "__s2": ("sum", c * c)}
    out = layout.running(df, {"rn": one}, totals)
    if level:
        mean = F.col("__s1") / F.col("n")
        spread = F.sqrt(F.greatest(F.col("__s2") / F.col("n") - mean * mean, F.lit(0.0)))
        out = out.withColumns(
            {"__mean": mean, "__spread": F.when(spread > 0, spread).otherwise(F.lit(1.0))}
        ).drop("__s1", "__s2")
    return out


def tail_split(
    df: DataFrame,
    test_days: int,
    min_train: int,
    spec: SeriesSpec,
    layout: Layout,
    level: str | None = None,
) -> DataFrame:
    """Mark the last ``test_days`` rows of each series as test rows.  Series
    with fewer than ``min_train`` remaining rows are skipped."""
    placed = with_position(df, spec, layout, level)
    train = F.col("n") - test_days
    return placed.where(train >= min_train).withColumn("is_test", F.col("rn") > train)
