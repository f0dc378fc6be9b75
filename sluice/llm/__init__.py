"""Operators of a training-data pipeline, one module each.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame; the thin ``opN_*`` queries live in ``registry``.
"""
