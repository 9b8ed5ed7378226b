"""Parquet tables and their views as price or return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.config import SeriesSpec

EVENTS = SeriesSpec()
ORDERS = SeriesSpec(order=("date", "o_orderkey"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known(c: Column) -> Column:
    """NaN counts as missing, as null does."""
    return F.when(~F.isnan(c), c)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Few long series: one per event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").alias("date"),
        "event_id",
        known(F.col("value")).alias("close"),
    )


def prices_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Many short series: one per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("symbol"),
        F.col("ts").alias("date"),
        "event_id",
        known(F.col("value")).alias("close"),
    )


def prices_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Long series with tied dates: one per order priority."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("date"),
        "o_orderkey",
        known(F.col("o_totalprice")).alias("close"),
    )


def returns(spark: SparkSession, folder: str) -> DataFrame:
    """Six (symbol, strategy) groups of returns; for order-free use only."""
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_linestatus").alias("strategy"),
        (F.col("l_discount") - F.lit(0.05)).alias("return_pct"),
        F.when(F.col("l_quantity") > 10, "Yes").otherwise("No").alias("investment_made"),
    )
