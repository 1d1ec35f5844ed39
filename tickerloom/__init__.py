"""Explainable market-research analytics as plain Spark DataFrame operations."""

__version__ = "0.1.0"
