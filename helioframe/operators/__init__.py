"""Joins, windows, aggregations and scoring over time series."""
