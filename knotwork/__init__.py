"""Spark-native graph community analytics and corpus preparation."""

__version__ = "0.1.0"
