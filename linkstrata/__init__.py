"""Spark-native operators over tables that hold many industry link graphs at once."""

__version__ = "0.1.0"
