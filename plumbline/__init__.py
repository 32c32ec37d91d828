"""Plumbline: automated analytics, feature engineering and model search on Spark DataFrames."""

__version__ = "0.1.0"
