"""Spark-native analytics over many price-like time series."""
