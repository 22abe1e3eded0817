"""Spark-native lexical similarity, keyword analytics and text statistics."""

__version__ = "0.1.0"
