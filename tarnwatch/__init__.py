"""Spark-native anomaly analytics over gridded water-quality observations."""

__version__ = "0.1.0"
