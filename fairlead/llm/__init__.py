"""Operators for large text corpora: search, filters, deduplication, extraction, tokens and packing.

Nothing else in the library imports this subpackage. ``catalog`` holds its named queries and the SQL that checks them.
"""
