"""Operators for training text: filters, near duplicates, tokens, search, mixing, sharding."""
