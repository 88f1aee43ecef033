"""Operators of a large-scale training-data pipeline.

Each module holds one operator over DataFrames; ``queries`` registers one query per
operator and ``store`` / ``texts`` / ``components`` are their shared helpers.  Nothing
outside this package imports it.
"""
