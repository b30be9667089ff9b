"""Operators of a training-data pipeline: deduplication, filtering, mixing, packing and search.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames
and has its own module; ``queries`` holds the thin registered queries.
"""
