"""Spark-native analytics for site and interval data."""
