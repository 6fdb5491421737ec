"""Spark-native analytics over code-evidence graphs."""
