"""Spark-native repair and analysis of legacy-encoded Devanagari text."""

__version__ = "0.2.0"
