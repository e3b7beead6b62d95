"""Leakage-safe screening of predictor columns, planned as Spark DataFrame work."""

__version__ = "0.1.0"
