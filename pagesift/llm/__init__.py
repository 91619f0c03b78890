"""Operators for training-data pipelines (dedup, tokens, filters, scoring)."""
