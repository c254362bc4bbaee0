"""Spark-native analytics for adaptive-mesh cell tables."""
