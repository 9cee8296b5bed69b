"""Spark-native analytics over sparse entity-by-feature count matrices."""

__version__ = "0.1.0"
