"""Operators of a training-data pipeline: packing, scoring, near-duplicates, mixing.

Nothing outside this package imports it. Every operator takes and returns DataFrames.
"""
