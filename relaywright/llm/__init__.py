"""Operators for preparing training text: deduplication, scoring, tokens, extraction, search."""
