"""Lowering folds to Spark plans."""
