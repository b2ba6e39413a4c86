"""Operators for preparing training text: deduplication, filters, tokenizing, packing.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it is present.
"""
