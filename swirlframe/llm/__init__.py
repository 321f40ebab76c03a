"""Training-data operators: text quality, language, near-duplicates, packing.

Nothing else in the library imports this subpackage.
"""
