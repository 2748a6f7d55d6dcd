"""Deriving, checking and refuting merges of folds."""
