"""Foliant: a Spark-first engine for retrieving and curating text knowledge."""

__version__ = "0.1.0"
