"""Retail panel features on Spark: dense panels, lags, trends, prices, profiles."""
