"""Spark-native analytics on price-bar time series, from ticks to dependence-preserving inference."""
