"""Spark-native analytics over hierarchical document corpora."""

__version__ = "0.1.0"
