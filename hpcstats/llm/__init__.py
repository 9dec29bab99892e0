"""Operators for preparing training data: dedup, filters, mixing, packing, formats.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
