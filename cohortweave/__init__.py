"""Spark-native analytics for cohorts of time series, weighted graphs and subject tables."""
