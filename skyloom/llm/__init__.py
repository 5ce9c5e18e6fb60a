"""Operators for large training corpora: filtering, deduplication, scoring, search and packing."""
