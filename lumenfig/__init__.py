"""Spark-native analytics over figures of scientific papers."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
