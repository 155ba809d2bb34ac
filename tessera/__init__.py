"""Spark-native analytics over static sets of boxes and geographic features."""
