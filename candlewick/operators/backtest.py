"""Buy/no-buy backtests over a prediction table.

Input rows are (keys..., order..., close, strategy, prediction) restricted to
the test tail, so each (symbol, strategy) series holds at most ``test_days``
rows and the ordered windows below stay small whatever the history's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.config import INITIAL_CAPITAL, SeriesSpec
from candlewick.functions.rounding import round_half_even

# Strategy label and flags of the result tables.
BUY_AND_HOLD = "Buy and Hold"
YES, NO = "Yes", "No"


def invested_flag(prediction: Column, close: Column) -> Column:
    return F.when(prediction > close, F.lit(YES)).otherwise(F.lit(NO))


def trade_signal(predictions: DataFrame, value: str = "close") -> DataFrame:
    flag = invested_flag(F.col("prediction"), F.col(value))
    return predictions.withColumn("investment_made", flag)


def _steps(rows: DataFrame, keys: list[str], spec: SeriesSpec):
    w = W.partitionBy(*keys).orderBy(*spec.order)
    price = F.col(spec.value)
    steps = rows.withColumn("next_price", F.lead(price).over(w)).where(
        F.col("next_price").isNotNull()
    )
    rate = F.try_divide(F.col("next_price") - price, price)
    return steps.withColumn("__rate", rate), w


def _daily_columns(spec: SeriesSpec, predicted: Column) -> list[Column]:
    def r2(c: Column, name: str) -> Column:
        return round_half_even(c, 2).alias(name)

    after, before = F.col("__after"), F.col("__before")
    invested = F.col("investment_made") == YES
    return [
        *[F.col(c) for c in spec.order],
        *[F.col(k) for k in spec.keys],
        F.col("strategy"),
        r2(F.col(spec.value), "current_price"),
        r2(predicted, "predicted_price"),
        r2(F.col("next_price"), "next_price"),
        F.col("investment_made"),
        r2(before, "capital_before"),
        r2(F.when(invested, before).otherwise(0.0), "capital_invested"),
        r2(after, "capital_after"),
        r2(after - before, "capital_gained"),
        round_half_even(F.when(invested, F.col("__rate")).otherwise(0.0), 4).alias("return_pct"),
    ]


def signal_days(
    predictions: DataFrame, capital: float = INITIAL_CAPITAL, spec: SeriesSpec = SeriesSpec()
) -> DataFrame:
    """One row per strategy and test day, capital compounding on invested days."""
    keys = [*spec.keys, "strategy"]
    rows, w = _steps(trade_signal(predictions, spec.value), keys, spec)
    factor = F.when(F.col("investment_made") == YES, 1.0 + F.col("__rate"))
    factor = F.coalesce(factor, F.lit(1.0))
    growth = F.product(factor).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__after", F.lit(capital) * growth)
    before = F.coalesce(F.lag("__after").over(w), F.lit(capital))
    return rows.withColumn("__before", before).select(
        *_daily_columns(spec, F.col("prediction"))
    )


def hold_days(
    tail: DataFrame, capital: float = INITIAL_CAPITAL, spec: SeriesSpec = SeriesSpec()
) -> DataFrame:
    """Buy on the first test day and keep: always invested, no prediction."""
    keys = list(spec.keys)
    w = W.partitionBy(*keys).orderBy(*spec.order)
    price = F.col(spec.value)
    worth = F.lit(capital) * F.try_divide(price, F.first(price).over(w))
    rows, _ = _steps(tail.withColumn("__before", worth), keys, spec)
    start = F.first(price).over(w)
    rows = rows.withColumns(
        {
            "__after": F.lit(capital) * F.try_divide(F.col("next_price"), start),
            "strategy": F.lit(BUY_AND_HOLD),
            "investment_made": F.lit(YES),
        }
    )
    return rows.select(*_daily_columns(spec, price))


def backtest_days(
    predictions: DataFrame,
    tail: DataFrame,
    capital: float = INITIAL_CAPITAL,
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """All signal strategies plus buy-and-hold."""
    return signal_days(predictions, capital, spec).unionByName(hold_days(tail, capital, spec))


def _final(rows: DataFrame, keys: list[str], growth: Column, capital: float) -> DataFrame:
    final = F.lit(capital) * growth
    return rows.groupBy(*keys).agg(
        F.lit(capital).alias("initial_value"),
        round_half_even(final, 2).alias("final_value"),
        round_half_even((final - capital) / capital, 4).alias("return_pct"),
    )


def consolidated(
    predictions: DataFrame,
    tail: DataFrame,
    capital: float = INITIAL_CAPITAL,
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """Final capital and total return, computed from unrounded capital."""
    keys = [*spec.keys, "strategy"]
    rows, _ = _steps(trade_signal(predictions, spec.value), keys, spec)
    factor = F.when(F.col("investment_made") == YES, 1.0 + F.col("__rate"))
    signal = _final(rows, keys, F.product(F.coalesce(factor, F.lit(1.0))), capital)
    order, price = F.struct(*spec.order), F.col(spec.value)
    growth = F.try_divide(F.max_by(price, order), F.min_by(price, order))
    hold = _final(tail.withColumn("strategy", F.lit(BUY_AND_HOLD)), keys, growth, capital)
    return signal.unionByName(hold)


def capital_curve(
    predictions: DataFrame,
    tail: DataFrame,
    capital: float = INITIAL_CAPITAL,
    spec: SeriesSpec = SeriesSpec(),
) -> DataFrame:
    """The plotted curve.  It uses another rule than the daily table: a step is
    taken when the *next* row's prediction exceeds the current price, and each
    curve starts at the initial capital."""
    keys = [*spec.keys, "strategy"]
    w = W.partitionBy(*keys).orderBy(*spec.order)
    price, prediction = F.col(spec.value), F.col("prediction")
    earlier = F.lag(price).over(w)
    factor = F.when(prediction > earlier, F.try_divide(price, earlier))
    rows = predictions.withColumn("__factor", F.coalesce(factor, F.lit(1.0)))
    growth = F.product("__factor").over(w.rowsBetween(W.unboundedPreceding, 0))
    kept = [*spec.keys, "strategy", *spec.order]
    signal = rows.withColumn("capital", F.lit(capital) * growth).select(*kept, "capital")
    by_key = W.partitionBy(*spec.keys).orderBy(*spec.order)
    worth = F.lit(capital) * F.try_divide(price, F.first(price).over(by_key))
    hold = tail.withColumns({"strategy": F.lit(BUY_AND_HOLD), "capital": worth})
    return signal.unionByName(hold.select(*kept, "capital"))
