"""Operators for preparing training text: search, dedup, scoring, filtering and mixing at corpus scale."""
