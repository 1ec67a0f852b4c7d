"""Spark-native data-quality engine: profile, detect, heal, score and report on DataFrames."""

__version__ = "0.1.0"
