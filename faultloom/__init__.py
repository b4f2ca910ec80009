"""Spark-native crash deduplication and record-linkage engine."""

__version__ = "0.1.0"
