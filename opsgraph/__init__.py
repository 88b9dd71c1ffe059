"""Spark operators for industrial operations data."""
