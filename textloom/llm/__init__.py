"""Operators that a training-data pipeline needs: deduplication, filtering, mixing, tokenisation.

Nothing outside this package imports it.
"""
