"""Operators for large text corpora: deduplication, filtering, classification, tokenising, formatting.

The rest of the library does not import this subpackage.
"""
