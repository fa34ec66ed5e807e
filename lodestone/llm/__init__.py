"""Training-data operators: quality filters, deduplication, mixing, tokenisation.

Nothing else in the library imports this subpackage.
"""
