"""Operators for preparing training text: identification, filtering, deduplication, repair and mixing."""
