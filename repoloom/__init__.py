"""Spark-native analytics over collections of source repositories."""
