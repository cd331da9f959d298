"""Operators for preparing training text: scoring, deduplication, mixing and packing."""
