"""Spark-native analytics over collections of rooted binary trees, and corpus preparation operators."""

__version__ = "0.1.0"
