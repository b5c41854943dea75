"""Spark-native analytics for collections of linked Markdown notes."""

__version__ = "0.1.0"
