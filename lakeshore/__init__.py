"""Spark-native ad-analytics lakehouse engine."""

__version__ = "0.1.0"
