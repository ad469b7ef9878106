"""Operators for the preparation of language-model training data."""
