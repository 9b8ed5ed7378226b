"""The tables behind the figures: histogram, box plot, radar, variability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.config import HISTOGRAM_BINS, RADAR_TOP
from candlewick.operators.distribution import with_quantiles
from candlewick.operators.stats import compare_variability, dispersion_comparison

RADAR_METRICS = (
    "desvio_padrao",
    "variancia",
    "coef_variacao",
    "amplitude_interquartil",
    "desvio_medio_absoluto",
)


def histogram(prices: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per symbol; the last bin includes its upper edge.  A
    constant series gets bins of total width one around its value.  Empty bins
    are listed with count 0."""
    rows = with_quantiles(prices, ("symbol",), "close", {})
    flat = F.col("low") == F.col("high")
    rows = rows.withColumns(
        {
            "lo": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
            "hi": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")),
        }
    )
    v, lo, width = F.col("close"), F.col("lo"), (F.col("hi") - F.col("lo")) / bins
    near = F.floor((v - lo) / (F.col("hi") - lo) * bins).cast("int")
    at = F.least(near, F.lit(bins - 1))
    # Division may land next to the bin whose printed edges enclose the value.
    shifted = F.when(v < lo + width * at, at - 1).when(
        (v >= lo + width * (at + 1)) & (at < bins - 1), at + 1
    )
    counted = (
        rows.withColumn("bin", F.coalesce(shifted, at) + 1)
        .groupBy("symbol", "lo", "hi", "bin")
        .agg(F.sum("cnt").alias("cnt"))
    )
    # A map of at most ``bins`` entries per symbol, then one row per bin.
    filled = counted.groupBy("symbol", "lo", "hi").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("counts")
    )
    return filled.select(
        "symbol", "lo", "hi", "counts", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    ).select(
        "symbol",
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_lo"),
        (F.col("lo") + width * F.col("bin")).alias("bin_hi"),
        F.coalesce(F.element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def boxplot_statistics(prices: DataFrame) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR of the box) and
    the number of rows beyond them."""
    rows = with_quantiles(
        prices, ("symbol",), "close", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    low, high, v = F.col("q1") - reach, F.col("q3") + reach, F.col("close")
    inside = (v >= low) & (v <= high)
    out = rows.groupBy("symbol").agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(v >= low, v)).alias("__low"),
        F.max(F.when(v <= high, v)).alias("__high"),
        F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).alias("outliers"),
    )
    # A whisker never ends inside the box.
    return out.select(
        "symbol",
        F.least("__low", "q1").alias("whisker_low"),
        "q1",
        "median",
        "q3",
        F.greatest("__high", "q3").alias("whisker_high"),
        "outliers",
    )


def variability_normalized(prices: DataFrame) -> DataFrame:
    table = compare_variability(prices)
    share = F.try_divide(F.col("variability"), table.agg(F.max("variability")).scalar())
    return table.select(
        "symbol",
        "variability",
        share.alias("share_of_max"),
        (share * 100).alias("normalized_variability"),
    )


def radar_metrics(
    prices: DataFrame, top: int = RADAR_TOP, described: DataFrame | None = None
) -> DataFrame:
    """The most volatile symbols with each metric divided by its maximum over
    all symbols (metrics whose maximum is not positive stay as they are)."""
    table = dispersion_comparison(prices, described=described)
    table = table.withColumn("__cv", F.col("coef_variacao"))
    maxima = table.agg(F.struct(*[F.max(m).alias(m) for m in RADAR_METRICS])).scalar()
    table = table.withColumn("__most", maxima)

    def scaled(name: str):
        most = F.col(f"__most.{name}")
        return F.when(most > 0, F.col(name) / most).otherwise(F.col(name)).alias(name)

    shares = table.select("symbol", "__cv", *[scaled(m) for m in RADAR_METRICS])
    return shares.orderBy(F.col("__cv").desc_nulls_last(), "symbol").limit(top).drop("__cv")
