"""Operators for building training data from raw text; nothing else in the library imports this package."""
