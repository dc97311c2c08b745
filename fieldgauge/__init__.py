"""Operational analytics on Spark: marketplace reports, experiment statistics,
entity time series, decision thresholds, churn models and equipment monitoring.

Every operator takes DataFrames and column names and returns a DataFrame.
"""
