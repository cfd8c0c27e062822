"""Keyed tables on Spark."""
