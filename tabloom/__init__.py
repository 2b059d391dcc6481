"""Reusable Spark operators for text counts, rollups, event publishing, statistics and series."""

__version__ = "0.1.0"
