"""Operators that prepare training text: identification, deduplication, filtering, mixing, encoding and search."""
