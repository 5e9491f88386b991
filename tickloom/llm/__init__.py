"""Operators for preparing training text: mixing, cleaning, deduplication and search."""
