"""Parameters shared by the operators, with the defaults users rely on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

# Default parameters.
TEST_DAYS = 30
EXPECTED_RETURN = 1.5
SIGNIFICANCE = 0.05
INITIAL_CAPITAL = 1000.0
POLYNOMIAL_DEGREES = (2, 5)
FOLDS = 5
MIN_TRAIN_ROWS = 30
ROLLING_ROWS = 7
HISTOGRAM_BINS = 20
RADAR_TOP = 6
GROUPING_CRITERIA = ("volatility", "mean_return", "investment_frequency")

# The five columns every regressor is trained on.
MODEL_FEATURES = ("mean_7d", "std_7d", "return_7d", "momentum_7d", "volatility_7d")

# Rows one task may hold of one ordered series before the series is split.
SLICE_ROWS_CONF = "spark.candlewick.sliceRows"
SLICE_ROWS = 4_000_000
# Upper bound on the number of cut points kept in a plan.  Beyond it slices grow
# past SLICE_ROWS instead; sorting a larger slice spills but works.
MAX_SLICES = 16_384


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_ROWS_CONF, str(SLICE_ROWS)))


@dataclass(frozen=True)
class SeriesSpec:
    """Which columns identify, order and measure a series.

    ``order`` must be a total order inside one key, so it normally ends in a
    unique id that breaks ties between equal dates.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("date", "event_id")
    value: str = "close"
