"""Where folds and rows come from."""
