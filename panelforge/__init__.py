"""Spark jobs for market and portfolio data, keyed by time and symbol."""
