"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` holds the thin registered queries.
"""
