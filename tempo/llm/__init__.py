"""Operators for preparing training data: deduplication, filters, tokenization and packing."""
