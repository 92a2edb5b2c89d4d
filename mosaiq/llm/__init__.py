"""Training-data operators: deduplication, quality, language, mixing, packing, scoring and search.

Nothing else in the library imports this subpackage.
"""
