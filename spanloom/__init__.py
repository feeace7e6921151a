"""Spanloom: telemetry analytics for LLM applications on Spark DataFrames."""

__version__ = "0.1.0"
