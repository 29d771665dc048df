"""Spark-native corpus preparation and batch retrieval."""
