"""Column functions with the fold language's meaning."""
