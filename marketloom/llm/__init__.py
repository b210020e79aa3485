"""Operators for large text corpora: filters, search, models, dedup, tokenizers, packing."""
