"""Spark-native repository and document analytics."""

__version__ = "0.1.0"
