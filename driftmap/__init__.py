"""Spark-native analytics over moving-entity location events."""
