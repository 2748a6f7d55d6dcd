"""The catalogue of aggregates and their queries."""
