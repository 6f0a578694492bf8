"""Spark-native analytics for tick-level financial time series."""
