"""Spark-native analytics for quantitative time series and the data behind them."""
