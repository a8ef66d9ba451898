"""Spark-native code-symbol graph engine."""

__version__ = "0.1.0"
