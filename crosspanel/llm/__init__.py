"""Operators for preparing text, pages and vectors as training data."""
