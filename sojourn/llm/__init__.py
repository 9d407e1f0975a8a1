"""Operators for preparing training text: tokens, filters, duplicates, packing, rollups.

Nothing else in the library imports this package. Every operator takes a DataFrame of documents (columns
``doc_id`` and ``text``, any others are left alone) and returns a DataFrame; ``queries`` registers one query each.
"""
