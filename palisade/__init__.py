"""Spark-native analytics over read-to-reference alignment tables."""
