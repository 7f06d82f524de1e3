"""Operators for preparing language-model training data from tables of texts."""
