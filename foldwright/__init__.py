"""Mergeable user-defined aggregates on Spark."""
