"""Spark-native analytics for agent traces and training-data pipelines."""
