"""Spark-native transformation-by-example engine."""
