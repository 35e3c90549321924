"""Spark-native document retrieval, evaluation analytics and corpus preparation."""

__version__ = "0.1.0"
