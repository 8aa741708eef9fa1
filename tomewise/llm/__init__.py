"""Operators for preparing training text: deduplication, mixing, scoring, search and encoding."""
