"""Training-data operators: quality, deduplication, privacy, tokens, scoring.

Nothing else in the library imports this package.
"""
