"""Operators of a training-data pipeline: mixing, near-duplicates, formatting,
line and document deduplication, scoring, search, tokens and sharding.

Each module holds one operator as functions from DataFrames to DataFrames.
``queries`` applies every operator with production parameters to its table.
"""
