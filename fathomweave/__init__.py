"""Spark-native engine that turns technical text and message traces into a queryable property graph."""

__version__ = "0.1.0"
