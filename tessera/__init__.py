"""Spark-native analytics for label identification and cluster induction over annotated text."""

__version__ = "0.1.0"
