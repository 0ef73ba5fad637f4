"""Spark-native associative retrieval, lifecycle maintenance and event analytics."""

__version__ = "0.1.0"
