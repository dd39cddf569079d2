"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` holds the thin contract queries over them.
"""
