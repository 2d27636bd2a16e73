"""Operators for large training-text corpora, and their queries."""
