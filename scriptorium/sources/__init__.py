"""Readers that turn packages, text tables, pages and turns into document tables."""
