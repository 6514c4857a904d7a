"""Spark-native analytics for object-detection datasets and their reports."""
