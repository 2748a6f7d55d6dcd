"""The fold language: types, expressions, JSON and text forms, typing and evaluation."""
