"""Folds over streams."""
