"""Spark-native GPS route analytics."""
