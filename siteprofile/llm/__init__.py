"""Operators for building training corpora with Spark."""
