"""Spark-native profile extraction, cleaning and benchmarking engine."""
